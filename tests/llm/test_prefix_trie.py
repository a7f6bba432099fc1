"""The prefix trie against a plain trie in Python."""

import hashlib
import random
import zlib

from talewright.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, owner int"


def paths_of(rows):
    """{conv_id: rebuilt turns}."""
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def plain(rows):
    paths = paths_of(rows)
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(k) == len(n) + 1 and k[: len(n)] == n for k in members)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(paths[c]) == len(node)))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids(node), sum(kids(n) == 0 for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    found = trie.prefix_trie(trie.rebuilt(trie.turns(df))).collect()
    places = sorted(r.preorder for r in found)
    assert places == list(range(len(found)))
    assert all(r.preorder < r.subtree_end <= len(found) for r in found)
    got = [tuple(r)[:8] for r in found]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, convs, longest, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(("user", "bot")), rng.choice(words)) for c in convs for t in range(rng.randint(0, longest))]


def test_trie_equals_plain(spark):
    rows = made(1, range(-7, 60), 12, ("a", "b"))
    assert run(spark, rows) == plain(rows)


def test_trie_of_copies_and_prefixes(spark, monkeypatch):
    """Many conversations of few shapes, small blocks everywhere, and ends that take several rows."""
    for name, n in (("BLOCK", 4), ("DEPTHS", 3), ("LOT", 4)):
        monkeypatch.setattr(trie, name, n)
    rows = [(c, t, "user", "é" if t % 2 else "x") for c in range(90) for t in range((c * 7) % 4 + 9)]
    rows += made(5, range(100, 130), 30, ("only",))
    assert run(spark, rows) == plain(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "", ""), (2, 3, "user", None), (3, 0, "user", "日本 🙂"), (3, 1, None, "z" * 50_000), (8, 0, "user", "a"), (8, 1, "usera", ""), (13, 5, "user", "a")]
    assert run(spark, rows) == plain(rows)


def test_trie_of_turnless_conversations(spark):
    """Ids whose conversations lose all their turns, as their block's first one is absent."""
    ids = [c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:12]
    rows = [(c, t, "user", "t") for c in ids for t in range(2)]
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_trie_with_one_long_conversation_and_a_copy(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    monkeypatch.setattr(trie, "DEPTHS", 32)
    keep = [c for c in range(0, 2000, 5) if zlib.crc32(str(c).encode()) % 9 == 0][:2]
    rows = [(c, t, "user", str(t % 7)) for c in keep for t in range(150)] + [(keep[0] + 1000, t, "user", str(t % 7)) for t in range(40)]
    assert run(spark, rows) == plain(rows)


def test_equal_turns_and_repeated_rows_have_one_order(spark):
    rows = [(c, 0, "user", t) for c in (0, 5, 45) for t in "abcabc"]
    assert run(spark, rows) == run(spark, rows[::-1])


def test_trie_of_no_rows(spark):
    assert run(spark, []) == set() and run(spark, [(None, 0, "user", "x")]) == set()
