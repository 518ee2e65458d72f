"""Op 11 against a plain trie: copies, prefixes, long conversations over many pieces, odd rows."""

import random
import zlib
from hashlib import sha256

from skyframe.llm import op11_conversation_trie as op11

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part long, conv string, k1 int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {k: [] for k in members}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        leaves = 0 if children[k] else 1
        for x in children[k]:
            saved, leaves = saved + sums[x][0], leaves + sums[x][1]
        sums[k] = saved, leaves
        ends = sorted(c for c in members[k] if len(whole[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), parent, len(members[k]), len(children[k]), leaves, saved, sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, files=5):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(files)
    return sorted((tuple(r) for r in op11.conversation_trie(df).collect()), key=str)


def chat(c, *texts):
    return [(c, i, "user" if i % 2 else None, t) for i, t in enumerate(texts)]


def test_against_a_plain_trie(spark):
    rng = random.Random(3)
    rows = []
    for c in range(0, 420):
        if c not in (100, 300):  # some hundreds have no first conversation
            rows += chat(c, *(rng.choice(["a", "bb", "ccc", "ä\U0001f600"]) for _ in range(rng.randrange(1, 7))))
    for c in range(1000, 1100):  # copies of one conversation, and of its prefixes
        rows += chat(c, *["same", "again", "and", "again", "to", "the", "end"][: 7 if c % 3 else 4])
    rows += chat(2000, *(f"turn {i % 7}" for i in range(900))) + chat(2001, *(f"turn {i % 7}" for i in range(900))) + chat(2002, *(f"turn {i % 7}" for i in range(700)))
    rows += [(None, 1, "user", "lost"), (5000, None, None, None), (5000, None, "user", None), (5000, 3, "user", "x"), (5000, 3, "user", "x"), (5000, 3, "a", "x"), (-205, 1, "u", "n"), (-105, 0, "u", "n")]
    assert trie(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert trie(spark, [], 1) == []
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lone, 0, "u", "replaced by what is not there")]
    assert trie(spark, rows, 1) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, sha256(str(lone).encode()).hexdigest())]


def test_lists_of_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(op11, "ENDS_CHUNK", 3)
    rows = [r for c in range(400, 500) for r in chat(c, "one", "text", "of", "very", "many", "copies")]
    assert trie(spark, rows) == brute(rows)


def test_parents_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(op11, "HOT_PARENTS", 2)
    rows = [r for c in range(0, 300, 100) for r in chat(c, "a", f"b{c}", "c", "d", "e", "f", f"g{c}")] + [r for c in range(1, 40) for r in chat(c, "a", "x", f"y{c % 3}", f"z{c % 5}")]
    assert trie(spark, rows) == brute(rows)
