"""All that is told of a novel's shots, in one reading of its text.

``shots`` and ``project`` have each step as an operator on a table of shots. Here a novel's text is a row that meets its people, scenes and
narrator (a few rows, as arrays), and one pass cuts its shots and goes along them: subject, scene, size, move, length, picture, unit, time and
prompt. What stands between the steps (hits, names, cues) is never a row, nothing is sorted, and only texts and small tables are shuffled, no shots.
A worker holds the shots of one text, which it has cut anyway, and BATCH finished rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewright.functions import automaton, segment
from talewright.functions.lexicon import DEFAULT, Lexicon
from talewright.functions.shared import slices

from . import project, shots
from .classify import folded, folded_all, mixed

#: Finished rows that a worker holds.
BATCH = 4096
KINDS = {
    "shot_no": "int", "unit_no": "int", "hard": "boolean", "shot_id": "string", "narr": "string", "size": "string", "move": "string", "dur": "double", "start": "double", "code": "string", "unit_start": "double", "unit_code": "string",
    "who": "string", "who_from": "string", "phrase": "string", "scene": "string", "hit": "string", "lens": "string", "n_chars": "int", "prompt": "string",
}
COLUMNS = tuple(KINDS)
_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
_BLANK = re.compile("[ \t\n\x0b\f\r　]")
_NOT_ME = re.compile("其[他她我]")
_MODIFIER = frozenset("的家宅府")
#: Sets of marks, and lengths, whose pictures a worker remembers.
REMEMBERED = 1 << 16


class Marks:
    """Words and patterns that a shot may hold, each a bit. Words, and patterns that are words joined by bars, are found in one reading."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.patterns: list[tuple[Callable, int]] = []
        self.n = 0

    def _bit(self) -> int:
        self.n += 1
        return 1 << (self.n - 1)

    def word(self, word: str) -> int:
        return self.pattern(re.escape(word)) if not word else self._words([word])

    def pattern(self, pattern: str) -> int:
        parts = pattern.split("|")
        if all(p and not re.search(r"[\\.^$*+?{}()\[\]]", p) for p in parts):
            return self._words(parts)
        bit = self._bit()
        self.patterns.append((re.compile(pattern).search, bit))
        return bit

    def _words(self, words: list[str]) -> int:
        bit = self._bit()
        for w in words:
            self.words[w] = self.words.get(w, 0) | bit
        return bit

    def reader(self) -> Callable[[str], int]:
        known, patterns = automaton.built(self.words.items()), self.patterns

        def read(text: str) -> int:
            out = 0
            for _, bits in known.iter(text) if known is not None else ():
                out |= bits
            for search, bit in patterns:
                if search(text):
                    out |= bit
            return out

        return read


def _uses(narr: str, words: list[tuple[str, str, int]]) -> list[tuple]:
    """(name, word, rank, hits, own) of words that a shot names: as ``shots.mentions``."""
    found = []
    for name, word, rank in words:
        at, hits, own = narr.find(word), [], []
        while at >= 0:
            end = at + len(word)
            hits.append(at)
            if narr[end : end + 1] not in _MODIFIER or narr.startswith(word, end):
                own.append(at)
            at = narr.find(word, end)
        found.append((name, word, rank, hits, own))
    return found


class Picture(NamedTuple):
    """What a set of marks says of a shot's picture: size; the face behind a subject, and what the subject does (null: a reaction is picked); the
    parts after a subject, and those of a shot without one; else what its kind shows (empty: it has none)."""

    size: str
    face: str
    does: str | None
    after: str
    alone: str
    kind: str | None


def _clock(t: int) -> str:
    return f"{t // 600}:{math.floor(t % 600 / 10 + 0.5):02d}"


def teller(lex: Lexicon, target: int, wpm: int, sec_per_shot: float, units: tuple[int, int, int], columns: tuple[str, ...] = COLUMNS) -> Callable[[str, list, str, list, str], Iterator[tuple]]:
    """The function that gives the rows (in the order of COLUMNS) of a novel by its text, people (rank, name, gender, desc), narrator, scenes (rank,
    name, desc) and style. Texts that are in none of the columns asked for are not made."""
    marks = Marks()
    cues = {n: [(marks.word(k), p) for k, p in lex.CUES[n]] for n in ("face", "light", "object", "noun", "jump", "action")}
    sizes, kinds, traits = [(marks.pattern(p), s) for p, s in lex.SIZES], [(marks.pattern(p), n) for n, p in lex.KINDS], [(marks.word(k), k, p) for k, p in lex.TRAITS]
    address, crowd = marks.pattern(lex.ADDRESS), marks.pattern(lex.CROWD)
    dialogue, pronouns = marks.pattern("「|『"), marks.pattern("我|他|她")
    any_trait = sum(bit for bit, *_ in traits)
    read, mental = marks.reader(), dict(list(shots.KIND_LENS.items())[: lex.MENTAL])
    longest, pace, moves = max(8.0, 1.5 * sec_per_shot), float(wpm), lex.MOVE_CYCLE
    ids, codes, unit_codes, prompts = (c in columns for c in ("shot_id", "code", "unit_code", "prompt"))
    pick = lambda values, seed, salt: values[mixed(folded(f"#{salt}", seed)) % len(values)]

    @lru_cache(REMEMBERED)
    def picture(bits: int) -> Picture:
        of = lambda name: next((p for bit, p in cues[name] if bits & bit), None)
        size = next((s for bit, s in sizes if bits & bit), None) or ("近景" if bits & dialogue else "中景")
        kind = next((n for bit, n in kinds if bits & bit), None)
        face, thing, noun, light, jump = map(of, ("face", "object", "noun", "light", "jump"))
        acts = [p for bit, p in cues["action"] if bits & bit and p is not None][:2]
        does = "，" + "、".join(acts) if acts else shots.TOGETHER if bits & crowd else None if face is None else ""
        last = [x for x in (light, jump, shots.TO_US if bits & address else None) if x is not None]
        things = [] if thing is None else [thing + shots.CLEAR]
        thought = [mental[kind]] if kind in mental and not acts and thing is None and jump is None else []
        alone = (things or ([] if noun is None else [noun + shots.INSERT])) + last
        return Picture(size, "" if face is None else f"，{face}", does, "".join(f"；{x}" for x in things + last + thought), "；".join(alone + thought) if alone else "", "" if kind is None else shots.KIND_LENS.get(kind))

    @lru_cache(REMEMBERED)
    def lasts(n: int) -> tuple[float, int]:
        dur = min(longest, max(2.0, math.floor(n / pace * 60 * 10 + 0.5) / 10))
        return dur, math.floor(dur * 10 + 0.5)

    def lens_of(seed: int, seen: Picture, spoken: bool, who: str, phrase: str | None, scene: str) -> str | None:
        # a shot that names a place is there, so no picture cuts to a place beside its scene
        if who:
            tail = seen.face if phrase is None else f"，{phrase}"
            does = seen.does if seen.does is not None else f"，{seen.size}{pick(shots.REACTIONS, seed, 'rxn')}"
            return (who + tail + does + seen.after)[:80]
        if seen.alone:
            return seen.alone[:80]
        if spoken:
            return pick(shots.UNSEEN, seed, "nod")[:80]
        if seen.kind != "":
            return seen.kind and seen.kind[:80]
        return (scene + pick(shots.EMPTY, seed, "empty") if scene else f"{shots.NOTHING[0]}{seen.size}{shots.NOTHING[1]}")[:80]

    def trait(narr: str, bits: int, found: list[tuple]) -> tuple | None:
        for bit, key, phrase in traits:
            if bits & bit:
                k = narr.find(key)
                gaps = [(k - max(h for h in hits if h < k) - len(word), rank, name, phrase) for name, word, rank, hits, _ in found if hits[0] < k]
                near = min((g for g in gaps if 0 <= g[0] <= 8), default=None)
                if near:
                    return near
        return None

    def tell(text: str, people: list[dict], narrator: str, scenes: list[dict], style: str) -> Iterator[tuple]:
        parts = segment.shots_of(text, target, lex.CREDITS)
        names = {p["name"] for p in people}
        words = [(p["name"], p["name"], p["rank"]) for p in people] + [(full, alias, 1000 + i) for i, (alias, full) in enumerate(lex.ALIASES) if full in names]
        sexes = {p["name"]: p["gender"] for p in people if p["gender"]}
        looks, views = ({p["name"]: p["desc"].strip(" ") for p in some if p["desc"] is not None} for some in (people, scenes))
        places, style = [p["name"] for p in scenes], style.strip(" ")
        held, here, sizes_, tenths, scene = [], [], [], [], ""
        for narr in parts:
            hit = None
            for p in places:
                if p in narr:
                    hit = scene = p
                    break
            n = len(narr) - len(_BLANK.findall(narr))
            here.append(hit)
            held.append(scene)
            sizes_.append(n)
            tenths.append(lasts(n)[1])
        of, hard = project.unit_numbers(held, tenths, *units) if parts else ([], [])
        here.append(None)
        prior, before, since, unit, past = None, 0, 0, 0, ""
        for k, narr in enumerate(parts):
            if k % BATCH == 0:
                seeds = folded_all(parts[k : k + BATCH])
            bits, scene = read(narr), held[k]
            seen, spoken = picture(bits), bool(bits & dialogue)
            near = [w for w in words if w[1] in narr]
            found = _uses(narr, near) if near else near
            named = [(-len(own), own[0], rank, name, at[0]) for name, _, rank, at, own in found if own]
            named = min(named) if named else None
            near = trait(narr, bits, found) if found and bits & any_trait else None
            who, why, phrase = "", "", None
            if near:
                who, why, phrase = near[2], "氣質詞", near[3]
            else:
                clean = "" if not bits & pronouns else _NOT_ME.sub("其其", narr) if "其" in narr else narr
                me = clean.find("我")
                if named and (me < 0 or named[4] <= me):
                    who, why = named[3], "點名"
                elif me >= 0 and narrator:
                    who, why = narrator, "我＝敘述者"
                elif named:
                    who, why = named[3], "點名"
                elif prior is not None and ("他" in clean or "她" in clean):
                    he, she, sex = "他" in clean, "她" in narr, sexes.get(prior)
                    want = "f" if she and not he else "m" if he and not she else ""
                    if not want or sex is None or want == sex:
                        who, why = prior, "代名詞"
            spots = [(-max(own[-1] if own else -1, 0 if at[0] == 0 else -1), rank, name) for name, word, rank, at, own in found if word == name and (own or at[0] == 0)]
            if spots:
                prior = min(spots)[2]
            move = "緩慢推近" if not k or (past and past != scene) else "固定" if spoken else "緩慢拉遠" if here[k + 1] is not None else moves[k % len(moves)]
            lens = lens_of(seeds[k % BATCH], seen, spoken, who, phrase, scene)
            prompt = "\n\n".join([x for x in (looks.get(who), views.get(scene), (lens or "").strip(" "), style) if x]) if prompts else None
            if of[k] != unit:
                since, unit = before, of[k]
            n = sizes_[k]
            yield (
                k, unit, hard[unit], f"S{k + 1:03d}" if ids else None, narr, seen.size, move, lasts(n)[0], before / 10, _clock(before) if codes else None, (before - since) / 10, _clock(before - since) if unit_codes else None,
                who, why, phrase, scene, here[k], lens, n, prompt,
            )
            before += tenths[k]
            past = scene

    return tell


def drawn(novels: DataFrame, persons: DataFrame, narrators: DataFrame, scenes: DataFrame, columns: tuple[str, ...] = COLUMNS, lex: Lexicon = DEFAULT, target: int = 17, wpm: int = shots.WPM, sec_per_shot: float = shots.SEC_PER_SHOT, units: tuple[int, int, int] = (project.UNIT_MIN, project.UNIT_MAX, project.TAIL)) -> DataFrame:
    """(novel_id and columns, of COLUMNS): the shots of normalised novels (novel_id, text and maybe style). persons (novel_id, rank, name, gender) and
    scenes (novel_id, rank, name) may have desc, for prompts; unit_start and unit_code tell the time within the unit."""
    desc = lambda df: F.col("desc") if "desc" in df.columns else F.lit(None).cast("string").alias("desc")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    cast = persons.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "name", "gender", desc(persons)))).alias("_p"))
    seen = scenes.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "name", desc(scenes)))).alias("_s"))
    style = F.coalesce("style", F.lit("")) if "style" in novels.columns else F.lit("")
    rows = novels.select("novel_id", F.coalesce("text", F.lit("")).alias("text"), style.alias("_style")).join(cast, "novel_id", "left").join(seen, "novel_id", "left").join(narrators.select("novel_id", F.col("name").alias("_n")), "novel_id", "left")
    rows = rows.select("novel_id", "text", none("_p", "array<struct<rank:int,name:string,gender:string,desc:string>>"), F.coalesce("_n", F.lit("")).alias("_n"), none("_s", "array<struct<rank:int,name:string,desc:string>>"), "_style")
    at, kinds = [COLUMNS.index(c) for c in columns], [_ARROW[KINDS[c]] for c in columns]

    def batch(keys: list, some: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        values = list(zip(*some, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(values[i], k) for i, k in zip(at, kinds, strict=True))], names=["novel_id", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = teller(lex, target, wpm, sec_per_shot, units, columns)
        for b in slices(batches):
            kind, keys, some = b.schema.field(0).type, [], []
            for novel, *told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for row in tell(*told):
                    keys.append(novel)
                    some.append(row)
                    if len(some) == BATCH:
                        yield batch(keys, some, kind)
                        keys, some = [], []
            if some:
                yield batch(keys, some, kind)

    return rows.mapInArrow(run, ", ".join([f"novel_id {rows.schema['novel_id'].dataType.simpleString()}", *(f"`{c}` {KINDS[c]}" for c in columns)]))
