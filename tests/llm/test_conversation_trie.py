"""Conversation tries against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from plumbline.llm import conversation_trie
from plumbline.llm.queries import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_chars string, place long"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def ordered(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), len(text or "")))
    return {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, m in members.items():
        own = (len(m) - 1) * (k[-1][1] if k else 0)
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + own
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
    return sorted((
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()), key=repr)


def conversations(seed, long=False):
    rng = random.Random(seed)
    rows = []
    for c in list(range(-3, 40)) + list(range(98, 130)) + [205, 300, 512]:
        n = rng.choice([60, 64, 65, 128, 129, 150]) if long and rng.random() < 0.3 else rng.randint(1, 9)
        for t in range(n):
            same = rng.random() < 0.8
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same or t < 3 else f"other {rng.randrange(3)}", "x", None, 7))
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


ODD = [
    (1, None, None, None, None, None, None), (1, None, "user", None, None, None, None), (1, 3, "user", "é😀 \x00", None, None, None), (1, 3, "user", "é😀 \x00", None, None, None),
    (2, None, None, None, None, None, None), (None, 1, "user", "of nobody", None, None, None), (3, 5, "a", "b" * 100_000, None, None, None), (3, 5, "ab", "", None, None, None),
    (100, 1, "x", "y", None, None, None), (105, 1, "x", "y", None, None, None), (-7, 0, "", "x", None, None, None)]


@pytest.mark.parametrize("rows", [conversations(1), conversations(2, True), ODD, [(c, 0, "user", "same", "", "", 0) for c in range(500, 900)], []], ids=["short", "long", "odd", "copies", "empty"])
def test_nodes(spark, rows):
    turns, convs = conversation_trie.number(spark.createDataFrame(rows, SCHEMA))
    own = ordered(rows)
    assert got(conversation_trie.build(turns, convs)) == (brute(own) if own else [])
    assert got(conversation_trie.build(*rebuilt(turns, convs))) == (brute(rebuild(own)) if own else [])


def test_double_array_holds_what_was_placed():
    rng = random.Random(3)
    trie, placed, nodes = conversation_trie.DoubleArray(), {}, [1]
    for _ in range(600):
        node = nodes.pop(rng.randrange(len(nodes)))
        ids = sorted(rng.sample(range(300), rng.randint(1, 12)))
        trie.place(node, ids)
        for t in ids:
            assert trie.base[node] + t not in placed
            placed[trie.base[node] + t] = node
        nodes += [trie.base[node] + t for t in ids]
    assert all(trie.check[slot] == node for slot, node in placed.items())
    assert sum(x > 0 for x in trie.check) == len(placed)
