"""Each operator against a plain version on small made-up tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgate.llm import boosting, chat, classifier, decontamination, lm, minhash, mixing, pii, quality_rules, substrings, tokens
from textgate.llm._store import Store
from textgate.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6))) + rng.choice(["", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    out = [*base, base[0], base[1], None, "", " \n\t ", "one", "one two three four", "one two three four"]
    for k in range(12):
        words = base[2].split()
        words[k] = "changed"
        out.append(" ".join(words))
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(20)]
    out += ["Der Der Der " * 40, "a\nb\na\n" * 9, "Ünïcode ＷＯＲＤＳ 中文 😀 " * 5, prose(rng, 20_000), "x" * 50_000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    # extra columns with names the operators use inside
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("words", F.lit("x")).withColumn("mark", F.lit(None).cast("int")).withColumn("shard", F.lit(1)).withColumn("row", F.lit(2)).withColumn("taken", F.lit(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_substrings(docs, texts, empty):
    first, words = {}, [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    for cfg in (substrings.Substrings(hot_docs=3, sample=2), substrings.Substrings(hot_docs=10**6), substrings.Substrings(sample=1, hot_anchor=2, hot_docs=10**6)):
        for r in substrings.remove_repeats(docs, cfg).collect():
            w = words[r.doc_id]
            gone = [False] * len(w)
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < r.doc_id:
                    gone[k : k + 13] = [True] * 13
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_repeated_ids(spark):
    rng = random.Random(17)
    a, b = prose(rng, 30), prose(rng, 40)
    rows = [(1, a), (1, a), (2, f"{b} {a}"), (2, b), (3, a), (None, a), (4, b), (5, "")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 30, 0): 2, (2, 70, 30): 1, (2, 40, 0): 1, (3, 30, 30): 1, (None, 30, 0): 1, (4, 40, 40): 1, (5, 0, 0): 1}


def test_suffix_automaton_matching_statistics():
    rng = random.Random(2)
    refs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    auto = substrings.SuffixAutomaton()
    for d, r in enumerate(refs):
        auto.add(r, d)
    auto.close()
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(200)]
    for doc in (1, 4, 99):
        want = [i for i in range(4, 200) if any(text[i - 4 : i + 1] == r[k : k + 5] for d, r in enumerate(refs) if d < doc for k in range(len(r) - 4))]
        assert list(auto.ends(text, 5, doc)) == want


def _components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(root)
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return sets, root


def test_near_duplicates(docs, texts, empty, spark):
    sets, root = _components(texts)
    for cfg in (minhash.MinHash(), minhash.MinHash(block=3, group=2, shingles=100)):
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, cfg).collect()}
        assert len(got) == len(texts)
        assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[d]), root[d], root[d] == d) for d, r in got.items())
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_near_duplicates_give_fewer_rows_than_documents(spark):
    """A family in which most pairs come near: clusters and links stay linear, and lose nothing."""
    rng = random.Random(12)
    base, family = prose(rng, 90).split(), []
    for _ in range(1200):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(90)] = prose(rng, 1)
        family.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    cfg = minhash.MinHash()
    table = minhash.signatures(docs, cfg).select("doc_id", "n_shingles", "signature", F.col("doc_id").alias("component"), F.lit(0).alias("side")).toArrow()
    assert minhash._near(table, cfg).num_rows <= 1200
    one_block = docs.select("doc_id", "text", F.col("doc_id").alias("component"), F.lit(0).alias("side")).toArrow()
    links = minhash._uniting(one_block, cfg)
    assert links.num_rows < 1200
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    parent = list(range(1200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [set(zip(w, w[1:], w[2:], w[3:], w[4:])) for w in (t.split() for t in family)]
    for b in range(1200):
        for a in range(b):
            x, y = root(a), root(b)
            if x != y and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n):
                parent[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in range(1200)}
    pairs = dict(zip(links.column("a").to_pylist(), links.column("b").to_pylist()))
    assert all(root(a) == root(b) for a, b in pairs.items())


def test_near_duplicates_with_repeated_rows(spark):
    rng = random.Random(3)
    a, b = prose(rng, 40), prose(rng, 50)
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, a), (4, b), (5, ""), (5, ""), (6, None), (None, a), (None, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == {(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 2, (4, 1, False): 1, (5, 5, True): 2, (6, 6, True): 1, (None, None, False): 3}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == [(False, 1), (False, 5), (False, 6), (True, 0), (True, 0), (True, 0)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_quality_rules(docs, texts, empty):
    for r in quality_rules.quality_rules(docs).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_distances(docs, texts):
    """Both distances against numpy."""

    def distance(p, q):
        m = (p + q) / 2
        part = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
        return np.sqrt(max((part(p) + part(q)) / 2, 0))

    for r in quality_rules.quality_rules(docs.where("doc_id < 40")).collect():
        words = WORD.findall(texts[r.doc_id] or "")
        letters = "".join(words)
        counts = {"symbol": sum(c in "#*$%&|<>@^~=+/\\{}[]_" for c in letters), "upper": sum(c.isupper() for c in letters), "mark": sum(c in ".,;:'()-!?0123456789" for c in letters)}
        classes = np.array([*counts.values(), len(letters) - sum(counts.values())], float) / max(len(letters), 1)
        common = collections.Counter(w if w in quality_rules.VOCABULARY else w[:1].lower() + w[1:] for w in words)
        found = [common[w] for w in quality_rules.VOCABULARY]
        shares = np.array([*found, len(words) - sum(found)], float) / max(len(words), 1)
        want = [min(distance(x, np.array(ref[k])) for ref in quality_rules.REFERENCES.values()) for x, k in ((classes, "classes"), (shares, "common"))]
        assert [r.class_distance, r.word_distance] == pytest.approx(want, abs=1e-9)


def test_quality_rules_at_any_length(spark):
    rng = random.Random(8)
    made = lambda: "".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(3, 10)))
    common = quality_rules.COMMON_WORDS["en"]
    words, weights = [*common, None], [*common.values(), 1000 - sum(common.values())]
    lengths = (60, 100, 150, 190, 210, 400)
    menus = [(k, " ".join(f"{made().capitalize()} |" for _ in range(n // 2))) for k, n in enumerate(lengths)]
    clean = [(100 + k, " ".join((w or made()) + ("." if j % 12 == 11 else "") for j, w in enumerate(rng.choices(words, weights, k=n)))) for k, n in enumerate(lengths)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(menus + clean, "doc_id long, text string")).collect()}
    assert got == {d: d >= 100 for d, _ in menus + clean}


def test_personal_data(docs, empty, spark):
    samples = ["mail a.b@c.de, or x@y now", "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 no 4111 1111 1111 1112", "tel +1 (017) 555-7713 ok", "see https://a.b/c?d. account number: 12345678", None, ""]
    rows = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(rows, mask=True).collect()}
    assert [got[k].n_email for k in range(7)] == [1, 0, 0, 0, 0, 0, 0]
    assert [got[k].n_ip for k in range(7)] == [0, 3, 0, 0, 0, 0, 0]
    assert [got[k].n_card for k in range(7)] == [0, 0, 1, 0, 0, 0, 0]
    assert [got[k].n_phone for k in range(7)] == [0, 0, 0, 1, 0, 0, 0]
    assert got[4].masked == "see <URL>. account number: <ACCOUNT>"
    assert got[0].masked == "mail <EMAIL>, or x@y now"
    assert pii.mask_documents(docs).columns == docs.columns
    assert pii.personal_data(empty).count() == 0


def test_personal_data_cues_in_any_case():
    anchors = pii.automaton()
    key = "sk-" + "aB3" * 60
    want = {
        "Account number: 12345678 ok": "Account number: <ACCOUNT> ok",
        "SSN 123456789": "SSN <ACCOUNT>",
        "Passport No X1234567.": "Passport No <ACCOUNT>.",
        f"API_KEY={key} end": "API_KEY=<ACCOUNT> end",
        f"İß api_key: '{key}'": "İß api_key: '<ACCOUNT>'",
        "password: Sword!fish": "password: <ACCOUNT>",
        "see HTTPS://A.b/c?d.": "see <URL>.",
        "pay DE89370400440532013000 AND more": "pay <IBAN> AND more",
        "to DE89 3704 0044 0532 0130 00, now": "to <IBAN>, now",
        "not DE89370400440532013001 HERE": "not DE89370400440532013001 HERE",
        "account holders pay; the password is lost": "account holders pay; the password is lost",
        "account" * 50_000 + " 12345": "account" * 50_000 + " <ACCOUNT>",
    }
    assert {t: pii.masked(t, pii.spans(t, anchors)) for t in want} == want


def test_personal_data_against_patterns():
    rng, anchors = random.Random(1), pii.automaton()
    for _ in range(8000):
        t = "".join(rng.choice("01234567890123456789..--@@++  ()ab%_Ü\n") for _ in range(rng.randrange(60)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [s for s in pii.spans(t, anchors) if s[0] in pii.BASE] == want


def test_token_counts(docs, texts, empty):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path(tokens.TOKENIZER))
    own = tokens.Tokenizer(tokens.load(path))
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = [*"abcdefghijklmnopqrstuvwxyz'''''stmdrvle  \n\tABCÉÜßñ0129½²٣.,;!?#$<>|-_", "<|endoftext|>", "'re", "'ll", "Σ", "İ", "中", "😀", "\x1c", "\x85", "̀"]
    fuzz = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(1500)] + ["", "'", "'l", "'r", "'lx"]
    want = [len(e.ids) for e in library.encode_batch(fuzz, add_special_tokens=False)]
    assert own.counts(fuzz).tolist() == want
    for r in tokens.token_counts(docs, path).collect():
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)
    assert tokens.token_counts(empty, path).count() == 0


def test_classifier_held_out(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        good = k % 3 != 0
        rows.append((k, prose(rng, 60) if good else (prose(rng, 60).upper() if k % 2 else "ha ha ha " * 20), "en", "s", 0))
        labels.append((k, int(good)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, label int")
    model = classifier.fit(docs, labels.where(~classifier.held_out("doc_id")))
    out = classifier.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.label for r in out]) > 0.97
    nothing = classifier.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in classifier.score(docs, nothing).collect()} == {0.5}
    assert classifier.score(empty, model).count() == 0


def test_trees_against_a_plain_walk():
    """Flattened trees give what walking each tree node by node gives."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(float)
    cfg = boosting.Boosting(trees=12, depth=3)
    forest = boosting.train(x, y, cfg)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + int(row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        return total

    assert forest.margins(x) == pytest.approx([walk(r) for r in x])
    assert np.mean((forest.predict(x) >= 0.5) == y) > 0.9
    # the first cut is the best of all
    p = 1 / (1 + np.exp(-forest.start))
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (-1.0, 0, 0.0)
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])):
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= cfg.min_rows:
                best = max(best, (sum(g[s].sum() ** 2 / (h[s].sum() + cfg.ridge) for s in (low, ~low)), f, cut))
    root = forest.roots[0]
    assert (forest.feature[root], forest.threshold[root]) == (best[1], best[2])


@pytest.mark.parametrize("sizes", [(100, 3), (40, 40, 1), (1, 1, 1), (25, 25), (7,), (60, 30, 5)])
def test_blocks_of_a_group(spark, sizes):
    """Members of different components meet exactly once; the largest component is copied for the blocks of the others alone."""
    rows = [(7, 1000 * c + k, c) for c, n in enumerate(sizes) for k in range(n)] + [(8, 5, 1), (8, 6, 2)]
    df = spark.createDataFrame(rows, "g int, doc_id long, component long")
    groups = minhash._groups(df, ["g"], F.lit(0))
    out = minhash._in_blocks(df, groups, ["g"], lambda n, size: F.ceil(n / 10), minhash.MinHash()).where("g = 7").collect()
    tasks, met = collections.defaultdict(list), collections.Counter()
    for r in out:
        tasks[r.x, r.y].append(r)
    for task in tasks.values():
        left, right = [r for r in task if r.side != 2], [r for r in task if r.side != 1]
        met.update({(a.doc_id, b.doc_id) if a.doc_id < b.doc_id else (b.doc_id, a.doc_id) for a in left for b in right if a.component != b.component})
    want = {(a, b) for (_, a, c), (_, b, d) in itertools.combinations(rows[: sum(sizes)], 2) if c != d}
    assert met == dict.fromkeys(want, 1)
    most, rest = max(sizes), -(-(sum(sizes) - max(sizes)) // 10)
    if sum(sizes) > 10:
        assert len(out) == most * max(rest, 1) + (sum(sizes) - most) * (max(rest, 1) + -(-most // 10))


def test_language_model(docs, texts, empty):
    words = [[*WORD.findall(low(t)), None] for t in texts]
    train = [w for d, w in enumerate(words) if zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    for cfg in (lm.LogBilinear(sweeps=2), lm.LogBilinear(frequent=20, vocabulary=8, sweeps=2)):
        for r in lm.scores(docs, cfg).collect():
            w = words[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            assert r.score < 0
    assert lm.scores(empty).count() == 0


def test_language_model_counts_whole_corpus(spark):
    train = spark.range(9000).selectExpr("id as doc_id", "concat('w', id, ' both', if(id % 3 = 0, ' both', '')) as text")
    listed, n, total = lm.frequent_words(train, lm.LogBilinear())
    assert len(listed) == 9001 and total == n.sum() == 21_000 and n[0] == 12_000 and set(n[1:]) == {1}
    sizes = [lm.LogBilinear().model_words(10**k) for k in (7, 8, 9)]
    assert 1022 < sizes[0] < sizes[1] < sizes[2]
    lexicon, store = lm.Lexicon(listed, 4), Store(spark)
    pairs, docs = lm.counts(train, lexicon, store)
    by_next = lm.turned(pairs, 6, store)
    want = collections.Counter()
    ids = {int(h): min(k, 4) for k, h in enumerate(listed.view(np.int64))}
    code = lambda w: min(ids[int(lm._words.word_hashes(lm.pa.array([w]))[0].view(np.int64)[0])] + (ids[int(lm._words.word_hashes(lm.pa.array([w]))[0].view(np.int64)[0])] == 4), 5)
    for k in range(9000):
        line = [4, code(f"w{k}"), *[0] * (1 + (k % 3 == 0)), 4]
        want.update(a * 6 + b for a, b in zip(line, line[1:]))
    assert docs == 9000 and unpacked(pairs, 6) == want
    assert unpacked(by_next, 6) == {k % 6 * 6 + k // 6: n for k, n in want.items()}
    store.clear()


def unpacked(pairs, width):
    blocks, out = lm.blocks_of(width), {}
    for r in pairs.collect():
        for key, n in zip(*map(np.ndarray.tolist, lm._unpacked(r.n)), strict=True):
            out[(key // width * blocks + r.block) * width + key % width] = n
    return out


def test_language_model_scores_are_a_plain_softmax(docs, texts):
    """Scores against words looked up one by one and every normaliser summed anew."""
    words = [[low(w) for w in WORD.findall(t or "")] for t in texts]
    train = [w for d, w in enumerate(words) if zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(x for w in train for x in w)
    cfg = lm.LogBilinear(frequent=40, vocabulary=12, sweeps=2, steps=4)
    lexicon, frequency, number, model = lm.trained(docs.where(~lm.held_out()), cfg)
    size = lexicon.model
    assert number == len(train) and len(model.b) == size + 2 and size < lexicon.size < len(c)
    hashed = lambda w: lm._words.word_hashes(lm.pa.array([w]))[0]
    place = {w: int(lexicon.positions(hashed(w))[0]) for w in {x for line in words for x in line}}
    code = lambda w: place[w] if place[w] < size else size + 1
    logits = model.h.astype(float) @ model.q.T.astype(float) + model.b
    table = [[x - math.log(sum(map(math.exp, row))) for x in row] for row in logits]
    outside = {w: n for w, n in c.items() if place[w] >= size}
    rest = sum(outside.values()) + 0.5 * (len(outside) + 1)
    for r in lm.scores(docs, cfg).collect():
        line = [size, *(code(w) for w in words[r.doc_id]), size]
        want = sum(table[a][b] for a, b in itertools.pairwise(line)) / math.log(10)
        want += sum(math.log10((c[w] + 0.5) / rest) for w in words[r.doc_id] if code(w) > size)
        assert r.score == pytest.approx(want, rel=1e-4)


def test_language_model_climbs_to_the_frequencies(spark):
    """Words that follow by a chain of known chances: trained rows come near them, rows of one block as those of another."""
    rng = np.random.default_rng(3)
    chain = rng.dirichlet(np.full(12, 0.4), 12)
    lines = []
    for _ in range(600):
        line = [int(rng.integers(12))]
        while len(line) < 60:
            line.append(int(rng.choice(12, p=chain[line[-1]])))
        lines.append(" ".join(f"w{x}" for x in line))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    out = lm.scores(docs, lm.LogBilinear(smoothing=1)).toPandas()
    held = out[out.held_out]
    best = sum(math.log10(chain[int(a[1:]), int(b[1:])]) for k in held.doc_id for a, b in itertools.pairwise(lines[k].split())) / len(held)
    assert len(held) > 80 and held.score.mean() > held.base_score.mean() + 10
    # the first word, the end and what the estimates lose
    assert held.score.mean() > best - 8
    again = lm.scores(docs.repartition(3), lm.LogBilinear(smoothing=1)).toPandas()
    assert np.allclose(again.sort_values("doc_id").score, out.sort_values("doc_id").score, rtol=1e-6)


def test_language_model_of_nothing_is_uniform(spark):
    held = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = lm.scores(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    # three tokens of a vocabulary of two, and two words that nothing is known of
    assert row.n_tokens == 3 and row.train_tokens == 0 and row.score == pytest.approx(3 * math.log10(0.5), rel=1e-5)


def test_language_model_sizes_are_bounded():
    cfg = lm.LogBilinear()
    assert cfg.model_words(10**14) == cfg.widest and cfg.list_words(10**14) == cfg.most_listed


def test_mixing(docs, texts, empty):
    out = mixing.mix_sources(docs, mixing.Mix(block=8, shard_docs=10)).collect()
    assert len(out) == len(texts)
    sources = docs.sparkSession.createDataFrame([(None, 100), ("b", 10), ("a", 1000)], "source string, n long")
    goal = {r.source: r.target for r in mixing.targets(Store(docs.sparkSession), sources).collect()}
    assert goal["b"] == 20.0 and goal[None] == 200.0 and goal["a"] == pytest.approx(1.5 * 1110 - 220)
    by = collections.defaultdict(int)
    for r in out:
        size = len(WORD.findall(texts[r.doc_id] or ""))
        assert r.size == size and 0 <= r.taken <= 2 * size
        by[r.source] += r.taken
    for r in out:
        assert abs(by[r.source] - r.target) <= 0.02 * r.target + 64
    again = mixing.mix_sources(docs.repartition(3), mixing.Mix(block=8, shard_docs=10)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_targets(spark):
    """Shares by weight with stops, against resharing source by source."""
    rng = random.Random(6)
    sizes = {name: rng.choice([0, 3, 40, 900, 20_000]) for name in [None, "", "Z", "a", "é", "\U0001f600", *(f"s{k}" for k in range(40))]}
    order = sorted(sizes, key=lambda n: (n is None, [ord(c) for c in n or ""]))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(order)}
    left, want, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        full = [n for n in open_ if left * weight[n] / sum(weight[m] for m in open_) > 2 * sizes[n]]
        want |= {n: 2 * sizes[n] for n in full} if full else {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        left -= sum(2 * sizes[n] for n in full)
        open_ = [n for n in open_ if n not in want]
    got = {r.source: r.target for r in mixing.targets(Store(spark), spark.createDataFrame(list(sizes.items()), "source string, n long")).collect()}
    assert got == pytest.approx(want)


def test_apportionment_by_highest_quotients(spark):
    rng, rows, want = random.Random(7), [], {}
    for g in range(2000):
        n = rng.randrange(1, 9)
        shards = [(k, rng.choice([0, 1, 49, 64, 1000, rng.randrange(1, 5000)]), rng.randrange(0, 80)) for k in range(n)]
        quota = rng.randrange(0, 120)
        rows += [(g, k, size, quota, limit) for k, size, limit in shards]
        seats = dict.fromkeys(range(n), 0)
        for _ in range(quota):
            able = [(-size / (2 * seats[k] + 1), k) for k, size, limit in shards if size and seats[k] < limit]
            if able:
                seats[min(able)[1]] += 1
        want |= {(g, k): v for k, v in seats.items()}
    big = [(-1, k, size, 1030, 10**6) for k, size in enumerate([100_040, *[49] * 60])]
    df = spark.createDataFrame(rows + big, "lot long, part long, words long, quota long, limit long")
    for few in (10_000, 3):
        got = {(r.lot, r.part): r.seats for r in mixing.apportion(Store(spark), df, "lot", "words", "quota", "limit", "part", few=few).collect()}
        assert got[-1, 0] == 1021 and {k: v for k, v in got.items() if k[0] >= 0} == want


def test_mixing_gives_the_taken_words(docs, texts, spark):
    cfg = mixing.Mix(block=8, shard_docs=10)
    base = docs.select("doc_id", "text", "source", "n_chars")
    twice = base.where("doc_id in (3, 4)")
    more = base.unionByName(twice).unionByName(twice.withColumn("source", F.lit("s9")))
    plan = collections.defaultdict(list)
    for r in mixing.mix_sources(more, cfg).where("taken > 0").collect():
        plan[r.doc_id, r.source].append(r)
    got = collections.defaultdict(list)
    for r in mixing.take_words(more, cfg).collect():
        got[r.doc_id, r.source].append((r.taken, WORD.findall(r.text)))
        assert r.taken == len(WORD.findall(r.text)) and r.n_chars == len(r.text)
    want = {k: sorted((r.taken, [w for x in r.stretches for w in WORD.findall(texts[k[0]])[x.first : x.last]]) for r in rows) for k, rows in plan.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    goal = {r.source: r.target for rows in plan.values() for r in rows}
    for source, target in goal.items():
        assert abs(sum(n for k, v in got.items() for n, _ in v if k[1] == source) - target) <= 0.02 * target + 64


def test_decontamination(docs, texts, empty, spark):
    rng = random.Random(4)
    item = prose(rng, 40)
    edited = item.split()
    edited[20] = "edited"
    part = " ".join(item.split()[:20])
    rows = [(900, f"{prose(rng, 50)} {item} {prose(rng, 9)}"), (901, " ".join(edited).upper()), (902, f"{prose(rng, 50)} {part}"), (903, None), (904, "a b c"), (905, "x a b c")]
    bench = spark.createDataFrame([(1, item), (2, "a b c"), (3, ""), (4, None)], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(more, bench).collect()}
    assert got == {(900, 1), (901, 1), (904, 2)}
    kept = decontamination.drop_contaminated(more, bench)
    assert {900, 901, 904} & {r.doc_id for r in kept.collect()} == set() and kept.count() == more.count() - 3
    shuffled = decontamination.contaminated(more.unionByName(more.where("doc_id = 900")), bench, decontamination.Decontamination(broadcast_shingles=0, broadcast_spots=0))
    assert sorted((r.doc_id, r.item_id) for r in shuffled.collect()) == sorted(got)
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(more, bench.limit(0)).count() == 0
    other = more.withColumnRenamed("text", "body").withColumn("text", F.lit("x"))
    assert decontamination.drop_contaminated(other, bench, text="body").count() == kept.count()


def test_preferences(spark):
    turns = "pair_id long, turn long, role string, text string"
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (3, 0, None, None), (None, 0, "user", "z")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "bad one"), (1, 2, "user", "why"), (2, 0, "user", "q")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(chosen, turns), spark.createDataFrame(rejected, turns)).collect()}
    one = got[1]
    assert one.prompt == "<|user|>\nq<|end|>\n" and one.chosen == "<|assistant|>\ngood<|end|>\n" and one.n_rejected_turns == 2
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "good<|end|>\n"
    assert got[2].n_prompt_turns == 1 and got[2].chosen == "" and not got[3].both and None not in got
    conv = spark.createDataFrame([(5, 0, "user", "q"), (5, 1, "assistant", "x"), (5, 2, "user", "r"), (5, 3, "assistant", "y"), (6, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    pair = {r.pair_id: r for r in chat.preferences(conv).collect()}
    assert pair[5].n_prompt_turns == 3 and "x" in pair[5].rejected and not pair[6].both


def test_pipeline(docs, spark, tmp_path):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    words = [r.text for r in base.where("doc_id = 5").collect()][0]
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, step = base, str(tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, out, step)
        if name != "mixing":
            assert after.columns == base.columns
        out = after
    ids = {r.doc_id for r in out.collect()}
    assert ids and 5 not in ids and 30 not in ids
    assert corpus_pipeline.run(spark, step).count() == len(ids)
