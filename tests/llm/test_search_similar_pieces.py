"""Interval search, Golay-code fuzzy hashing and piece tables against plain versions."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textgate.llm import fuzzy, pieces, search
from textgate.llm._store import Store

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeÉf") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ".", "-X"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [prose(rng, rng.randrange(3, 90)) for _ in range(120)]
    out += [out[0]] * 5 + [out[3] + " tail", None, "", " \n\t ", "one", "One two", "<P>sentinel", "İ ẞ K straße", "a\x00b\x1cc d\x85e", prose(rng, 20_000), "x" * 60_000, "日本語 😀 " * 40]
    for k in range(40):
        words = out[5].split()
        words[k % len(words)] = "other"
        out.append(" ".join(words))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("n", "form", "key", "fp", "root", "terms", "rank", "output", "node", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- ranked search


def _scores(rows, items, k):
    found = [(d, TERM.findall(low(t))) for d, t in rows]
    found = [(d, ws) for d, ws in found if ws]
    n, length = len(found), sum(len(ws) for _, ws in found)
    tf = [(d, len(ws), {w: ws.count(w) for w in set(ws)} if len(ws) < 500 else __import__("collections").Counter(ws)) for d, ws in found]
    out = []
    for item, text in items:
        best = []
        own = set(TERM.findall(low(text)))
        df = {t: sum(t in c for _, _, c in tf) for t in own}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        for d, size, c in tf:
            m = 100 - 90 + (90 * size * n) // length
            s = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                best.append((-s, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(best)[:k], 1)]
    return sorted(out, key=str)


def _items(rng):
    return [(k, prose(rng, rng.randrange(1, 30))) for k in range(25)] + [(90, "ONE two"), (91, "nowhere-to-be-found"), (92, ""), (93, "one"), (None, "two one")]


def test_ranked_search(spark, docs, rows):
    items = _items(random.Random(3))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit(1))
    want = _scores(rows, items, 10)
    for cfg in (search.Search(), search.Search(shard=16, leaf=1), search.Search(postings=50, leaf=4), search.Search(block_bytes=400)):
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(docs, table, cfg).collect()), key=str)
        assert got == want
    # repeated items count once
    assert search.ranked(docs, table.union(table)).count() == len(want)


def test_ranked_search_of_ties_repeated_and_null_ids(spark, empty):
    rows = [(7, "same words"), (3, "same words"), (3, "same words"), (None, "same words"), (5, "words"), (1, "other text here"), (2, None)] + [(100 + k, "same words") for k in range(20)]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "same"), (2, "same words"), (2, "text")], "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(docs, items).collect()), key=str)
    assert got == _scores(rows, [(1, "same"), (2, "same words"), (2, "text")], 10)
    few = [(9, "same"), (None, "same"), (4, "same"), (1, "x y"), (2, "x z"), (6, "z y"), (8, "z y")]
    assert [(r.doc_id) for r in search.ranked(spark.createDataFrame(few, SCHEMA), items.where("item_id = 1")).orderBy("rank").collect()] == [4, 9, None]
    assert search.ranked(empty, items).count() == 0
    assert search.ranked(docs, items.where("false")).count() == 0


# ---- fuzzy hashing


def _fingerprint(text):
    ws = WORD.findall(low(text))
    grams = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _roots(fps):
    root = list(range(len(fps)))
    at = np.array(fps, dtype=np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(at ^ at[i]) <= 4)
            least = min(root[j] for j in near)
            for j in near:
                if root[j] > least:
                    root[j], changed = least, True
    return root


def test_similar(docs, rows, empty):
    fps = [_fingerprint(t) for _, t in rows]
    root = _roots(fps)
    for cfg in (fuzzy.SimHash(), fuzzy.SimHash(block=3, small=2)):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in fuzzy.similar(docs, cfg).collect()}
        assert got == {d: (f"{f:016x}", r) for (d, _), f, r in zip(rows, fps, root, strict=True)}
    assert len(set(root)) < len(rows) - 10
    assert fuzzy.similar(empty).count() == 0


def test_similar_of_repeated_and_null_ids(spark):
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (2, b), (9, a), (None, a), (4, c), (None, None), (3, "")]
    got = sorted(((r.doc_id, r.component_id) for r in fuzzy.similar(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (5, 2), (2, 2), (9, 2), (None, None), (4, 4), (None, None), (3, 3)], key=str)


def test_keys_meet_for_every_pair_within_the_radius():
    golay, rng = fuzzy.Golay(), random.Random(4)
    opposite = {fuzzy.STORED: fuzzy.LOOKED_UP, fuzzy.LOOKED_UP: fuzzy.STORED, fuzzy.BOTH: fuzzy.BOTH}
    for _ in range(4):
        f = rng.getrandbits(64)
        others = [f ^ sum(1 << b for b in c) for w in (1, 2, 3) for c in rng.sample(list(combinations(range(64), w)), 60)]
        # two errors in one segment and one in each other, and all other ways of four
        for _ in range(400):
            bits = set()
            for (first, n), w in zip(fuzzy.SEGMENTS, rng.choice([(2, 1, 1), (1, 2, 1), (1, 1, 2), (4, 0, 0), (2, 2, 0), (0, 2, 2), (2, 0, 2), (3, 1, 0), (0, 1, 3), (1, 0, 3), (1, 1, 1)]), strict=True):
                bits |= {first + b for b in rng.sample(range(n), w)}
            others.append(f ^ sum(1 << b for b in bits))
        key, _, side = fuzzy.keys(np.array([f], np.uint64), golay)
        mine = set(zip(key.tolist(), side.tolist(), strict=True))
        key, at, side = fuzzy.keys(np.array(others, np.uint64), golay)
        met = {a for k, a, s in zip(key.tolist(), at.tolist(), side.tolist(), strict=True) if (k, opposite[s]) in mine}
        assert met == set(range(len(others)))


def test_a_hot_family_of_fingerprints(spark):
    """Thousands of fingerprints around two centres share keys: links stay linear, components exact."""
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for c in centres for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = _roots(fps)
    for cfg in (fuzzy.SimHash(), fuzzy.SimHash(block=64)):
        links = {r.node: r.root for r in fuzzy.links(table, Store(spark), cfg).collect()}
        groups = {}
        for s, r in zip(signed, want, strict=True):
            groups.setdefault(links.get(s, s), set()).add(r)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


# ---- piece tables


def _filled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, None if plain else len(p), None if plain else len(m), out, sha(out), sha(text))


def test_fill_in_middle(spark, docs, rows, empty):
    got = {r.doc_id: tuple(r) for r in pieces.fill_in_middle(docs).collect()}
    assert got == {d: _filled(d, t) for d, t in rows}
    assert {r[2] for r in got.values()} == {"plain", "psm", "spm"}
    more = [(None, "abc def"), (None, None), (6, "a<"), (6, "a<"), (8, "<P"), (10, "S><"), (11, "<<<P <S <M")]
    again = sorted((tuple(r) for r in pieces.fill_in_middle(spark.createDataFrame(more, SCHEMA)).collect()), key=str)
    assert again == sorted((_filled(d, t) for d, t in more), key=str)
    assert pieces.fill_in_middle(empty).count() == 0


def test_pieces_are_cut_arranged_and_put_back():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab<> é") for _ in range(rng.randrange(0, 30))).encode()
        whole = [pieces.Piece(pieces.TEXT, 0, len(text))] if text else []
        a, b = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        head, rest = pieces.cut(whole, a)
        middle, tail = pieces.cut(rest, b - a)
        buffers = (memoryview(text), memoryview(b"".join(pieces.MARKS)))
        for form in pieces.ARRANGEMENTS:
            out = b"".join(pieces.streamed(buffers, pieces.arranged((head, middle, tail), form)))
            back = (memoryview(out), buffers[1])
            assert b"".join(pieces.streamed(back, pieces.restored(back[0], form))) == text
