"""Facts about a whole text: style, era, season, modern technology; all are column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from talewright.functions.lexicon import DEFAULT, Lexicon


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used: searches of whole texts are dear."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _most(names: list[str], counts: list[Column], none: str) -> Column:
    """The name with the highest count, the earlier on ties; none where nothing counts."""

    def choose(c: Column) -> Column:
        out = F.when(F.array_max(c) == 0, none)
        for i, name in enumerate(names):
            out = out.when(c[i] == F.array_max(c), name)
        return out

    return let(F.array(*counts), choose)


def guess_style(text: Column, chosen: Column | None = None, lex: Lexicon = DEFAULT) -> Column:
    """The style with most hits, the earlier on ties, else the default; a valid choice of the caller's wins."""
    style = _most([n for n, _ in lex.STYLES], [hits(text, p) for _, p in lex.STYLES], lex.DEFAULT_STYLE)
    if chosen is not None:
        style = F.when(chosen.isin(lex.DEFAULT_STYLE, *(n for n, _ in lex.STYLES)), chosen).otherwise(style)
    return style


def detect_era(text: Column, lex: Lexicon = DEFAULT) -> Column:
    counts = F.array(hits(text, lex.ERA_MODERN), hits(text, lex.ERA_WEAK))
    counted = let(counts, lambda c: F.when(text.rlike(lex.ERA_NEAR) & (c[0] == 0), "近代").when((c[1] >= 3) & (c[1] > c[0]), "古裝").otherwise("現代"))
    return F.when(text.rlike(lex.ERA_CERTAIN), "古裝").otherwise(counted)


def season_scores(text: Column, lex: Lexicon = DEFAULT) -> list[Column]:
    out = []
    for _, _, groups in lex.SEASONS:
        score = F.lit(0)
        for pattern, weight in groups:
            score = score + hits(text, pattern) * weight
        out.append(score)
    return out


def detect_season(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """Phrase of the season with the highest score, in the order winter, spring, summer, autumn on ties; else empty."""
    return _most([phrase for _, phrase, _ in lex.SEASONS], season_scores(text, lex), "")


def has_modern_tech(text: Column, lex: Lexicon = DEFAULT) -> Column:
    return text.rlike(lex.MODERN_TECH)


def stable_hash(text: Column) -> Column:
    """FNV-1a over the code points and an avalanche of 32 bits, as a long. Equal to the usual hash for BMP text."""
    word = 1 << 32

    def times(h: Column, m: int) -> Column:  # modulo 2 ** 32, without leaving 63 bits
        return (F.pmod(h * (m >> 16), F.lit(word)) * 65536 + h * (m & 0xFFFF)) % word

    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * 16777619) % word)
    mixed = F.transform(F.array(h), lambda x: times(x.bitwiseXOR(F.shiftrightunsigned(x, 15)), 2246822507))
    mixed = F.transform(mixed, lambda x: times(x.bitwiseXOR(F.shiftrightunsigned(x, 13)), 3266489909))
    return F.transform(mixed, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 16)))[0]


def folded(text: str, h: int = 2166136261) -> int:
    """The hash's state after text, from h on."""
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def folded_all(texts: list[str]) -> list[int]:
    """``folded`` of many short texts at once, a character of all of them at a time."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes, start = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, falling = start[order], -size[order]
    h = np.full(len(texts), 2166136261, np.uint32)
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(falling, -j))  # so many are longer than j
        h[:n] = (h[:n] ^ codes[start[:n] + j]) * np.uint32(16777619)
    out = np.empty_like(h)
    out[order] = h
    return out.tolist()


def mixed(h: int) -> int:
    for shift, m in ((15, 2246822507), (13, 3266489909)):
        h = ((h ^ h >> shift) * m) & 0xFFFFFFFF
    return h ^ h >> 16


def fnv(text: str) -> int:
    """The stable hash of ``stable_hash``, for one text."""
    return mixed(folded(text))


def pick(values: list[str] | tuple[str, ...], seed: Column, salt: str, rank: Column | int = 0) -> Column:
    """A value that seed and salt choose, moved on by rank."""
    at = (stable_hash(F.concat(seed, F.lit(f"#{salt}"))) + rank) % len(values)
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def era_allows(value: str, era: str, modern_tech: bool = True, lex: Lexicon = DEFAULT) -> bool:
    ban = dict(lex.ERA_BAN).get(era)
    return not (ban and re.search(ban, value)) and (modern_tech or not re.search(lex.MODERN_BAN, value))


def season_for_novel(text: Column, era: Column, lex: Lexicon = DEFAULT) -> Column:
    """The season found in the text, else one of the era's pool that the first 200 characters choose."""
    pools = {name: [s for s, eras in lex.SEASON_POOL if name in eras.split()] for name in ("古裝", "近代", "現代")}

    def from_pool(h: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, pool in pools.items():
            out = out.when(era == name, F.element_at(F.array(*(F.lit(s) for s in pool)), (h % len(pool) + 1).cast("int")))
        return out.otherwise("")

    return let(detect_season(text, lex), lambda found: F.when(found != "", found).otherwise(let(stable_hash(F.substring(text, 1, 200)), from_pool)))


def facts_of(style: str = "", lex: Lexicon = DEFAULT) -> Callable[[str], list[str]]:
    """The function that gives [style, era, modern (1 or empty), season] of a text: what the columns above tell, from one reading by each
    pattern. A valid style that is named wins."""
    count = lambda p: lambda t, f=re.compile(p).finditer: sum(1 for _ in f(t))
    styles = [] if style in (lex.DEFAULT_STYLE, *(n for n, _ in lex.STYLES)) else [(n, count(p)) for n, p in lex.STYLES]
    none = lex.DEFAULT_STYLE if styles or not style else style
    seasons = [(phrase, [(count(p), weight) for p, weight in groups]) for _, phrase, groups in lex.SEASONS]
    pools = {name: [s for s, eras in lex.SEASON_POOL if name in eras.split()] for name in ("古裝", "近代", "現代")}
    certain, near, tech = (re.compile(p).search for p in (lex.ERA_CERTAIN, lex.ERA_NEAR, lex.MODERN_TECH))
    weak_, modern_ = count(lex.ERA_WEAK), count(lex.ERA_MODERN)

    def most(counts: list[tuple[str, int]], otherwise: str) -> str:
        name, n = max(counts, key=lambda x: x[1], default=(otherwise, 0))
        return name if n else otherwise

    def era_of(text: str) -> str:
        if certain(text):
            return "古裝"
        modern = modern_(text)
        if not modern and near(text):
            return "近代"
        weak = weak_(text)
        return "古裝" if weak >= 3 and weak > modern else "現代"

    def told(text: str) -> list[str]:
        era = era_of(text)
        season = most([(phrase, sum(n(text) * weight for n, weight in groups)) for phrase, groups in seasons], "")
        if not season and (pool := pools[era]):
            season = pool[fnv(text[:200]) % len(pool)]
        return [most([(name, n(text)) for name, n in styles], none), era, "1" if tech(text) else "", season]

    return told
