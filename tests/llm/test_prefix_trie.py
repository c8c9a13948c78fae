"""The trie of conversations against one built in memory, turn by turn."""

import hashlib
import math
import random
import zlib

import pytest

from auditloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, pos string, digest string, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "p", "d", "x") for r in rows], SCHEMA)


def in_memory(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for _, _, _, r, t in sorted(x)] for c, x in convs.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in members), len(p), parent, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    return sorted(map(tuple, prefix_trie.prefix_trie(table(spark, rows)).select(*COLUMNS).collect()), key=repr)


def random_rows(seed, convs=60, turns=12, texts=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(texts)} é") for c in rng.sample(range(200), convs) for t in range(rng.randrange(1, turns))]


ODD = [
    (1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "", "user"), (1, 3, "user", ""), (2, None, "use", "ra"), (2, 1, "user", "a"),
    (None, 0, "user", "gone"), (7, 5, "user", "only"), (11, 0, "u", "x"), (-4, 0, "u", "x"), (-3, 1, "u", "y"), (-10, 0, "u", "z"), (0, 9, "u", "x"), (0, 2, "u", "w" * 300_000), (2**62, 0, "u", "x"),
]


@pytest.mark.parametrize("rows", [random_rows(1), random_rows(2, texts=1), random_rows(3, convs=120, turns=4, texts=2), ODD, [], [(3, 0, "u", "x")]], ids=["mixed", "alike", "short", "odd", "empty", "one"])
def test_trie_equals_one_in_memory(spark, rows):
    assert trie(spark, rows) == in_memory(rows)


def test_long_conversations(spark):
    base = [(0, t, "u", f"t{t % 7}") for t in range(150)]
    branch = [(c, t, "u", f"t{t % 7}" if t < 97 + c else f"c{c}") for c in (1, 2, 20) for t in range(130 - c)]
    rows = base + branch + [(20 + i, t, "u", f"t{t % 7}") for i in (5, 10) for t in range(64)] + [(40, t, "u", "same") for t in range(33)]
    random.Random(4).shuffle(rows)
    assert trie(spark, rows) == in_memory(rows)


def test_hot_conversation_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 16)
    one = [(5, t, "u", f"turn {t}") for t in range(700)]  # most rows of the table
    many = [(c, t, "u", "hello" if t < 2 else f"own {c}") for c in range(100, 420) for t in range(3)]
    same = [(c, t, "a", "alike") for c in range(1000, 1300, 5) for t in range(2)]
    assert trie(spark, one + many + same) == in_memory(one + many + same)


def test_leaves_of_a_hand_made_trie(spark):
    got = prefix_trie.prefix_trie(table(spark, [(0, t, "u", x) for t, x in enumerate("abc")] + [(5, t, "u", x) for t, x in enumerate("abd")] + [(10, 0, "u", "a")]))
    top = {(r["depth"], r["conv_id"]): r for r in got.collect()}
    assert (top[0, 0]["n_leaves"], top[0, 0]["n_children"], top[0, 0]["saved_tokens"]) == (2, 1, 3)  # a twice more, b once more
    assert (top[1, 0]["n_convs"], top[1, 0]["n_leaves"]) == (3, 2)
    assert top[1, 0]["ends_sha256"] == hashlib.sha256(b"10").hexdigest()
