"""What each stage of the pipeline keeps and writes, against plain expectations."""

import collections
import random
import re

import pytest

import corpus_pipeline
from textgate.llm import quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in is was for on that with as it by at from they be this have not are or an which were their been has more when who will would there what so about out up into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


OTHER = "garden window river market letter winter morning kitchen village brother station teacher summer picture holiday mountain bridge doctor evening paper number question answer reason corner minute office engine island harvest walked turned looked carried opened closed found asked helped started bright quiet narrow heavy gentle early modern simple".split()


def _prose(rng, n):
    words = [rng.choices(COMMON, [1 / (k + 3) for k in range(len(COMMON))])[0] if rng.random() < 0.5 else rng.choice(OTHER) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def _windows(text, item):
    """The best weighted similarity of a window as long as the item."""
    low = [WORD.findall(t.lower()) for t in (text, item)]
    grams = lambda ws: collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    b, best = grams(low[1]), 0.0
    for k in range(max(1, len(low[0]) - len(low[1]) + 1)):
        a = grams(low[0][k : k + len(low[1])])
        common = sum((a & b).values())
        best = max(best, common / max(1, sum(a.values()) + sum(b.values()) - common))
    return best


def _sets(text):
    ws = WORD.findall(text.lower())
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def _targets(sizes):
    order = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(order)}
    left, want, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = [n for n in open_ if share[n] > 2 * sizes[n]]
        want |= {n: 2 * sizes[n] for n in full} if full else share
        left -= sum(2 * sizes[n] for n in full)
        open_ = [n for n in open_ if n not in want]
    return want


@pytest.fixture(scope="module")
def table():
    rng = random.Random(31)
    item = _prose(rng, 40)
    clean = [_prose(rng, rng.randrange(60, 200)) for _ in range(14)]
    near = clean[2].split()
    near[30] = "changed"
    texts = {k: t for k, t in enumerate(clean)}
    texts |= {20: clean[2], 21: " ".join(near), 22: clean[3]}  # copies, and a near one
    texts |= {30: f"{_prose(rng, 40)} {item} {_prose(rng, 40)}", 31: item.upper() + " " + _prose(rng, 3)}  # hold the item
    texts |= {40: f"{_prose(rng, 50)} Write to a.b@mail.example now. {_prose(rng, 20)}", 41: f'{_prose(rng, 60)} token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" {_prose(rng, 20)}'}
    junk = {50: None, 51: "", 52: "too short", 53: "buy now click here " * 40, 54: "| # $ % & " * 50}
    texts |= junk
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, t in texts.items()]
    return rows, item, set(junk)


def test_every_stage(spark, tmp_path, table):
    rows, item, junk = table
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, told = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        told[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {k: t for k, t, *_ in rows}
    # quality: junk goes, and what the verdict says of each text; most of the prose stays
    good = {r.doc_id for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert set(told["quality_rules"]) == good and not good & junk and len(good) >= 0.7 * len(set(texts) - junk)
    # one of each group of texts that share three quarters of their shingles
    left, first = sorted(good), {}
    for k in left:
        alike = [j for j in first if 100 * len(_sets(texts[k]) & _sets(texts[j])) >= 75 * len(_sets(texts[k]) | _sets(texts[j]))]
        if not alike:
            first[k] = True
    assert set(told["near_duplicates"]) == set(first) and len(first) < len(good)
    # decontamination
    kept = {k for k in first if _windows(texts[k], item) < 0.75}
    assert set(told["decontamination"]) == kept == set(first) - {30, 31}
    assert all(told["decontamination"][k].text == texts[k] for k in kept)
    # personal data
    masked = {k: texts[k].replace("a.b@mail.example", "<EMAIL>").replace("9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "<ACCOUNT>") for k in kept}
    assert {k: (r.text, r.n_chars) for k, r in told["personal_data"].items()} == {k: (t, len(t)) for k, t in masked.items()}
    # the mix: words of the document alone, as many as are told, near the source's target
    sizes, taken = collections.defaultdict(int), collections.defaultdict(int)
    for k in kept:
        sizes[told["personal_data"][k].source] += len(WORD.findall(masked[k]))
    for k, r in told["mixing"].items():
        mine, own = collections.Counter(WORD.findall(r.text)), collections.Counter(WORD.findall(masked[k]))
        assert r.taken == sum(mine.values()) and all(n <= 2 * own[w] for w, n in mine.items())
        taken[r.source] += r.taken
    for source, goal in _targets(dict(sizes)).items():
        assert abs(taken[source] - goal) <= 64 + 0.02 * goal


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]
