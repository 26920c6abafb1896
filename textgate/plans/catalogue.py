"""All registered queries and their SQL.

Each query is an ordinary DataFrame job over the given tables.  SQL follows the same steps with
DuckDB's functions; its regular expressions have ASCII classes and no look-around, so queries
whose rules need look-around or word alignment have no SQL and are tested against examples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgate.functions import contract, masks, relations
from textgate.functions import lexicons as lex
from textgate.functions import patterns as P
from textgate.operators import analysis, claims, explain, gate, guards, markdown, reports, rules, segment
from textgate.sources import tables
from textgate.streaming import requests

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- units: lines of documents, and pairs of a line with a changed copy of it

LINES_SQL = "lines AS (SELECT doc_id, lang, source AS src, i AS line_no, l AS line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE l <> '')"
CANDIDATE_SQL = r"""CASE line_no % 8 WHEN 0 THEN regexp_replace(line, ' [^ ]+$', '') WHEN 1 THEN regexp_replace(line, '[0-9]', '7', 'g') WHEN 2 THEN replace(line, ' is ', ' is not ') WHEN 3 THEN replace(line, ' the ', ' all ')
  WHEN 4 THEN replace(line, '.', '!') WHEN 5 THEN replace(line, ' and ', ' or ') WHEN 6 THEN 'You ' || line ELSE line END"""
PAIRS_SQL = f"{LINES_SQL}, pairs AS (SELECT doc_id, lang, src, line_no, line AS source, {CANDIDATE_SQL} AS candidate FROM lines)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.read(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "lang", F.col("source").alias("src"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.where("line <> ''").select("doc_id", "lang", "src", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a copy changed by its number: a word dropped, digits changed, a negation, a quantifier, ..."""
    kind, line = F.col("line_no") % 8, F.col("line")
    changed = (
        F.when(kind == 0, F.regexp_replace(line, " [^ ]+$", ""))
        .when(kind == 1, F.regexp_replace(line, "[0-9]", "7"))
        .when(kind == 2, F.replace(line, F.lit(" is "), F.lit(" is not ")))
        .when(kind == 3, F.replace(line, F.lit(" the "), F.lit(" all ")))
        .when(kind == 4, F.replace(line, F.lit("."), F.lit("!")))
        .when(kind == 5, F.replace(line, F.lit(" and "), F.lit(" or ")))
        .when(kind == 6, F.concat(F.lit("You "), line))
        .otherwise(line)
    )
    return lines(spark, sf_dir).select("doc_id", "lang", "src", "line_no", line.alias("source"), changed.alias("candidate"))


def planted(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """Lines with one of the phrases before them, chosen by id and number, so that every rule meets its case."""
    phrase = F.get(F.array(*[F.lit(p) for p in phrases]), ((F.col("doc_id") + F.col("line_no")) % len(phrases)).cast("int"))
    return rows.withColumn("line", F.concat(phrase, F.lit(" "), F.col("line")))


def _planted_sql(phrases: list[str], name: str = "lines") -> str:
    case = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(phrases))
    return f"{LINES_SQL}, {name}_p AS (SELECT doc_id, lang, src, line_no, (CASE (doc_id + line_no) % {len(phrases)} {case} END) || ' ' || line AS line FROM lines)"


#: One case for each screening family, and one for none.
SCREENED = ["for the purpose of", "there is a need for", "it was written by the team", "make a decision", "it seems to me", "revert back", "which is", "and we go and they stay", "they like it, to run, and then to walk", "a number of", "walking home, and to run", "do not forget to", ""]
CERTAIN = ["perhaps", "generally", "must", "should", "will", "can", "nearly", "plain"]
COUNTED = ["no longer", "no", "at most", "about ten", "each", "only", "never", "most", "just to see"]


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _gate_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){_re2(p)}') THEN '{family}'" for family, ps in lex.GATE for _, p in ps) + " END"


def _words_re(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


# ---- screening


@query()
def gate_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the family of their first hit, with every family."""
    sents = segment.sentences(documents(spark, sf_dir))
    hits = gate.screened(sents, "sentence").groupBy("family").agg(F.count("*").alias("n"))
    return reports.zero_filled(hits, "family", gate.FAMILIES, "n")


_SCREENED_SQL = _planted_sql(SCREENED)


@query(f"WITH {_SCREENED_SQL}, h AS (SELECT {_gate_sql('line')} AS family FROM lines_p) SELECT family, count(*) AS n FROM h WHERE family IS NOT NULL GROUP BY family")
def gate_line_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.screened(planted(lines(spark, sf_dir), SCREENED), "line").groupBy("family").agg(F.count("*").alias("n"))


@query(f"WITH {_SCREENED_SQL}, h AS (SELECT doc_id, line_no, {_gate_sql('line')} AS family FROM lines_p) SELECT doc_id, arg_min(family, line_no) AS family, min(line_no) AS line_no FROM h WHERE family IS NOT NULL GROUP BY doc_id")
def gate_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line that a family fires on."""
    rows = gate.screened(planted(lines(spark, sf_dir), SCREENED), "line")
    return rows.groupBy("doc_id").agg(F.min_by("family", "line_no").alias("family"), F.min("line_no").alias("line_no"))


def _gate_names_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){_re2(p)}') THEN '{_re2(name)}'" for _, ps in lex.GATE for name, p in ps) + " END"


@query(f"WITH {_SCREENED_SQL}, h AS (SELECT {_gate_names_sql('line')} AS name FROM lines_p) SELECT name, count(*) AS n FROM h WHERE name IS NOT NULL GROUP BY name")
def gate_pattern_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the name of their first pattern."""
    return gate.screened(planted(lines(spark, sf_dir), SCREENED), "line", "name").groupBy("name").agg(F.count("*").alias("n"))


@query(
    f"WITH {_SCREENED_SQL} SELECT lang, count(*) AS n_lines, "
    + ", ".join(f"count(*) FILTER (regexp_matches(line, '(?i){_re2('|'.join(f'(?:{p})' for _, p in ps))}')) AS {family.replace('-', '_')}" for family, ps in lex.GATE)
    + " FROM lines_p GROUP BY lang"
)
def gate_families_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = gate.family_hits(F.col("line"))
    return planted(lines(spark, sf_dir), SCREENED).groupBy("lang").agg(F.count("*").alias("n_lines"), *[F.count_if(h).alias(f.replace("-", "_")) for f, h in hits.items()])


@query()
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, complete ones, and the longest."""
    sents = segment.sentences(documents(spark, sf_dir))
    return sents.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("complete").alias("n_complete"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query()
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose offsets fit their text and their neighbours."""
    docs = documents(spark, sf_dir)
    sents = segment.sentences(docs)
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    # sentences follow each other and are as long as their offsets say
    fits = (F.length("sentence") == F.col("end") - F.col("start")) & F.coalesce(F.lag("end").over(order) <= F.col("start"), F.lit(True))
    return sents.select(fits.alias("exact")).groupBy("exact").agg(F.count("*").alias("n"))


# ---- tokens and features


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’]\p{L}+)*')) AS n_words, len(regexp_extract_all(text, '[^\s\p{L}\p{N}]+')) AS n_other FROM documents")
def token_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").withColumn("tokens", P.tokens(F.col("text")))
    return docs.select("doc_id", F.size(P.words(F.col("text"))).cast("long").alias("n_words"), F.regexp_count("text", F.lit(f"[^{P.BLANK}\\p{{L}}\\p{{N}}]+")).cast("long").alias("n_other"))


@query(r"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’]\p{L}+)*')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) SELECT lang, word, n, rank FROM r WHERE rank <= 20")
def top_words_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.read(spark, sf_dir, "documents").select("lang", F.explode(P.words(F.col("text"))).alias("word"))
    return reports.top_n(words.groupBy("lang", "word").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.asc("word")], 20).select("lang", "word", "n", F.col("rank").cast("long"))


# DuckDB's expressions have no look-ahead, and need no possessive group
_ID, _MAIL, _NUM = lex.PROTECTED[7], lex.PROTECTED[3], lex.NUMBER.replace("(?=(?:st|nd|rd|th)?\\b))*+", ")*").split(")?", 2)[-1]


@query(rf"SELECT doc_id, unnest(regexp_extract_all(text, '{_ID}')) AS identifier FROM documents")
def identifier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(P.found(F.col("text"), _ID)).alias("identifier"))


@query(rf"SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS email FROM documents")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(P.found(F.col("text"), _MAIL)).alias("email"))


@query(rf"WITH {PAIRS_SQL} SELECT line_no % 8 AS kind, count(*) AS n, count(*) FILTER (regexp_extract_all(source, '{_NUM}') <> regexp_extract_all(candidate, '{_NUM}')) AS changed FROM pairs GROUP BY ALL")
def number_sequence_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return rows.groupBy((F.col("line_no") % 8).alias("kind")).agg(F.count("*").alias("n"), F.count_if(guards.numbers(F.col("source")) != guards.numbers(F.col("candidate"))).alias("changed"))


_NEG, _SPELLED = _re2(lex.NEGATION), _re2("|".join(lex.NOT_AS_SPELLING))


def _denials(column: str) -> str:
    return f"(len(regexp_extract_all({column}, '(?i){_NEG}')) - len(regexp_extract_all({column}, '(?i){_SPELLED}')))"


@query(rf"WITH {PAIRS_SQL} SELECT line_no % 8 AS kind, sum({_denials('source')})::BIGINT AS before, sum({_denials('candidate')})::BIGINT AS after FROM pairs GROUP BY ALL")
def negation_count_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.sum(guards.negations(F.col(o))).alias(c) for c, o in (("before", "source"), ("after", "candidate"))]
    return pairs(spark, sf_dir).groupBy((F.col("line_no") % 8).alias("kind")).agg(*n)


@query(f"WITH {_planted_sql(CERTAIN)} SELECT doc_id, line_no, " + ", ".join(f"len(list_distinct(regexp_extract_all(lower(line), '{_words_re(g)}'))) AS g{k}" for k, g in enumerate(lex.CERTAINTY)) + " FROM lines_p")
def certainty_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(lines(spark, sf_dir), CERTAIN)
    return rows.select("doc_id", "line_no", *[F.size(guards.members(F.col("line"), g)).cast("long").alias(f"g{k}") for k, g in enumerate(lex.CERTAINTY)])


@query(f"WITH {LINES_SQL} SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(lower(line), '\\b{w}\\b')) AS {w}" for w in lex.ORDINALS) + " FROM lines")
def ordinal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).agg(*[F.count_if(P.matches(F.lower("line"), rf"\b{w}\b", False)).alias(w) for w in lex.ORDINALS])


def _quantifier_sql(group: int, word: str) -> str:
    if (group, word) == (0, "no"):
        return "len(regexp_extract_all(low, '\\bno\\b')) > len(regexp_extract_all(low, '\\bno\\s+longer\\b'))"
    if group == 3 and word in ("most", "least"):
        return f"regexp_matches(low, '\\bat\\s+{word}\\b')"
    if word in ("about", "around"):
        return f"regexp_matches(low, '\\b{word}\\s+{lex.QUANTITY}\\b|\\b{lex.QUANTITY}\\s+{word}\\b')"
    return f"regexp_matches(low, '\\b{word}\\b')"


_QUANTIFIERS_SQL = " UNION ALL ".join(f"SELECT lang, {k} AS grp, '{w}' AS word FROM q WHERE {_quantifier_sql(k, w)}" for k, g in enumerate(lex.QUANTIFIERS) for w in g)


@query(f"WITH {_planted_sql(COUNTED)}, q AS (SELECT lang, regexp_replace(lower(line), '^\\s*just\\b(\\s+(?:to\\s+\\pL|\\pL+ing\\b))', '\\1') AS low FROM lines_p) SELECT lang, grp, word, count(*) AS n FROM ({_QUANTIFIERS_SQL}) GROUP BY ALL")
def quantifier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by quantifier, with the narrow senses of some."""
    sets = guards.quantifier_sets(F.col("line"))
    rows = planted(lines(spark, sf_dir), COUNTED).select("lang", sets.alias("sets")).select("lang", F.posexplode_outer("sets").alias("grp", "words")).select("lang", "grp", F.explode_outer("words").alias("word")).where("word is not null")
    return rows.groupBy("lang", "grp", "word").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL} SELECT regexp_extract(rtrim(line), '([.!?…]+)[\"''’”)\\]}}]*$', 1) AS mark, count(*) AS n FROM lines GROUP BY ALL")
def terminal_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(guards.terminal(F.col("line")).alias("mark")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS_SQL} SELECT line_no % 8 AS kind, count(*) FILTER (regexp_extract(rtrim(source), '([.!?…]+)[\"''’”)\\]}}]*$', 1) <> regexp_extract(rtrim(candidate), '([.!?…]+)[\"''’”)\\]}}]*$', 1)) AS changed FROM pairs GROUP BY ALL")
def terminal_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy((F.col("line_no") % 8).alias("kind")).agg(F.count_if(guards.terminal(F.col("source")) != guards.terminal(F.col("candidate"))).alias("changed"))


_BAG = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+(?:[''’]\p{{L}}+)*'), lambda w: w NOT IN ('a', 'an', 'the'))"
_ARTICLES = r"len(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+(?:[''’]\p{{L}}+)*'), lambda w: w IN ('a', 'an', 'the')))"


@query(f"WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS other FROM lines) SELECT count(*) AS n, count(*) FILTER ({_BAG.format(c='line')} <> {_BAG.format(c='other')} AND len({_BAG.format(c='line')}) > 0 AND {_ARTICLES.format(c='other')} <= {_ARTICLES.format(c='line')}) AS reordered FROM p WHERE list_sort({_BAG.format(c='line')}) = list_sort({_BAG.format(c='other')})")
def pure_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines with the same words but for articles, and how many the guard of order refuses."""
    after = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(spark, sf_dir).withColumn("other", F.lead("line").over(after))
    bag = {c: F.array_sort(F.filter(P.words(F.col(c)), lambda w: ~w.isin("a", "an", "the"))) for c in ("line", "other")}
    return rows.where(bag["line"] == bag["other"]).agg(F.count("*").alias("n"), F.count_if(guards.order_changed(F.col("line"), F.col("other"))).alias("reordered"))


@query(f"WITH {PAIRS_SQL} SELECT line_no % 8 AS kind, count(*) FILTER (" + " OR ".join(f"len(regexp_extract_all(lower(candidate), '\\b{w}\\b')) < len(regexp_extract_all(lower(source), '\\b{w}\\b'))" for w in lex.SCOPE) + ") AS dropped FROM pairs GROUP BY ALL")
def scope_word_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy((F.col("line_no") % 8).alias("kind")).agg(F.count_if(guards.scope_dropped(F.col("source"), F.col("candidate"))).alias("dropped"))


def _families_sql(column: str) -> str:
    base = f"list_transform(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+(?:[''’]\\p{{L}}+)*'), lambda w: regexp_replace(w, '[''’](?:re|s|ve|ll|d|m)$', ''))"
    return ", ".join(f"list_has_any({base}, [{', '.join(repr(w) for w in g)}]) AS {column[0]}{k}" for k, g in enumerate(lex.PRONOUNS[:-1]))


@query(f"WITH {PAIRS_SQL}, f AS (SELECT line_no % 8 AS kind, {_families_sql('source')}, {_families_sql('candidate')} FROM pairs) SELECT kind, count(*) FILTER (" + " OR ".join(f"(c{k} AND NOT s{k})" for k in range(len(lex.PRONOUNS) - 1)) + ") AS changed FROM f GROUP BY kind")
def pronoun_families_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy((F.col("line_no") % 8).alias("kind")).agg(F.count_if(guards.pronouns_changed(F.col("source"), F.col("candidate"))).alias("changed"))


# ---- alignment and verdicts


@query()
def edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("ops", guards.edit_ops(F.col("source"), F.col("candidate")))
    return rows.groupBy((F.col("line_no") % 8).alias("kind")).agg(F.round(F.avg(guards.edit_ratio(F.col("ops"))), 6).alias("mean_ratio"), F.sum(F.size(F.filter("ops", lambda o: o["type"] == "delete"))).alias("deleted"))


@query()
def validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay: pairs by kind of change, bucket and reason."""
    verdicts = analysis.replayed(pairs(spark, sf_dir))
    return verdicts.groupBy((F.col("line_no") % 8).alias("kind"), "bucket", "reason").agg(F.count("*").alias("n"))


@query()
def verdict_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of accepted pairs by language with its Wilson interval."""
    verdicts = analysis.replayed(pairs(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "accepted").alias("k"))
    low, high = P.wilson(F.col("k"), F.col("n"))
    return verdicts.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def clarity_rules_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire on lines with one of their phrases put before."""
    rows = lines(spark, sf_dir)
    phrases = F.array(*[F.lit(p) for p, _, _ in lex.RULES])
    text = F.concat(P.capitalised(F.get(phrases, F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(len(lex.RULES))).cast("int"))), F.lit(" the "), F.col("line"))
    # outer ones, as Spark moves the test of an inner one below and looks for the rules once more
    fired = rows.select(F.explode_outer(rules.rules_fired(text)).alias("rule")).where("rule is not null")
    return fired.groupBy("rule").agg(F.count("*").alias("n"))


@query()
def mechanics_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of lines with doubled spaces and blanks before commas, by kind of repair."""
    text = F.regexp_replace(F.regexp_replace("line", ",", " ,"), " of ", "  of ")
    rows = rules.repaired(lines(spark, sf_dir).select("lang", text.alias("text")), "text")
    return rows.select("lang", F.explode_outer("ids").alias("id")).where("id is not null").groupBy("lang", "id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_replace(regexp_replace(line, ' of ', '  of ', 'g'), '([^\\s])[ \\t]{{2,}}([^\\s])', '\\1 \\2', 'g') AS fixed FROM lines")
def mechanics_repeated_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", rules.single_spaced(F.regexp_replace("line", " of ", "  of ")).alias("fixed"))


_OPENER_SQL = r"""regexp_replace(regexp_extract(line, '^\s*(\S*)', 1), '[.!?…]+$', '')"""


@query(rf"""WITH {LINES_SQL}, o AS (SELECT *, {_OPENER_SQL} AS opener, length(regexp_extract(line, '^\s*', 0)) AS at_ FROM lines)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\s*\p{{Ll}}') AND NOT regexp_matches(line, '^\s*\p{{Ll}}\p{{L}}*\p{{Lu}}') AND NOT regexp_matches(opener, '[./\@_]|^\p{{L}}+[0-9]') THEN line[:at_] || upper(line[at_ + 1]) || line[at_ + 2:] ELSE line END AS opened FROM o""")
def capitalise_opener(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", rules.capital_opener(F.col("line")).alias("opened"))


# ---- joins and reports


@query("SELECT d.lang, l.quality, count(*) AS n, count(*) FILTER (regexp_matches(d.text, '(?i)\\b(which|that|who) (is|are|was|were)\\b')) AS n_hit FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def label_join_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(gate.family_hits(F.col("text"), ["relative-bloat"])["relative-bloat"]).alias("n_hit"))


@query("SELECT d.source, count(*) AS n FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def label_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT d.lang, count(*) AS total, count(*) FILTER (l.quality = 1) AS surfaced, count(*) FILTER (l.quality = 1) / count(*) AS recall, quantile_disc(d.n_chars, 0.5) AS p50, quantile_disc(d.n_chars, 0.95) AS p95, max(d.n_chars) AS top FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def summary_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id")
    return reports.summary(joined, ["lang"], F.col("quality") == 1, "n_chars")


@query("SELECT lang, count(*) FILTER (q = 'good') AS good, count(*) FILTER (q = 'bad') AS bad, count(*) FILTER (q = 'none') AS none FROM (SELECT d.lang, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'none' END AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY lang")
def pivot_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id", "left")
    bucket = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("none")
    return reports.pivoted(joined.withColumn("bucket", bucket), "lang", "bucket", ["good", "bad", "none"])


@query("SELECT r.reason, count(d.doc_id) AS n FROM (VALUES ('short'), ('long'), ('huge'), ('empty')) r(reason) LEFT JOIN (SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'long' ELSE 'huge' END AS reason FROM documents) d ON d.reason = r.reason GROUP BY r.reason")
def ledger_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    reason = F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "long").otherwise("huge")
    return reports.zero_filled(docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")), "reason", ["short", "long", "huge", "empty"], "n")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def ledger_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_n(tables.read(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "doc_id", "n_chars")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").groupBy("event_type").agg(*reports.nearest_rank("value", {"p50": 0.5, "p95": 0.95}), F.max("value").alias("top"))


_WILSON_SQL = "greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))"


@query(f"SELECT lang, round({_WILSON_SQL}, 6) AS low, round({_WILSON_SQL.replace('greatest(0,', 'least(1,').replace('- 1.96', '+ 1.96')}, 6) AS high FROM (SELECT d.lang, count(*)::DOUBLE AS n, (count(*) FILTER (l.quality = 1))::DOUBLE AS k FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang)")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id")
    rates = joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = P.wilson(F.col("k"), F.col("n"))
    return rates.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT item_id, lpad(to_hex(list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT), lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::BIGINT)), 8, '0').lower() AS key FROM benchmark")
def fnv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "benchmark").select("item_id", P.fnv1a(F.col("text")).alias("key"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts; texts travel as digests."""
    rows = documents(spark, sf_dir).select(F.md5("text").alias("key"), "doc_id", "source")
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS before, length(text) - lag(length(text)) OVER w AS grown FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_turn_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text")
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), (size - F.lag(size).over(w)).alias("grown"))


@query("WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’]\\p{L}+)*')) AS w FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’]\\p{L}+)*')) AS w FROM documents) SELECT (SELECT count(*) FROM b) AS n_benchmark, (SELECT count(*) FROM d) AS n_documents, (SELECT count(*) FROM (SELECT w FROM b UNION SELECT w FROM d)) AS n_union, (SELECT count(*) FROM (SELECT w FROM b INTERSECT SELECT w FROM d)) AS n_shared, (SELECT count(*) FROM (SELECT w FROM b EXCEPT SELECT w FROM d)) AS n_only")
def vocabulary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two vocabularies, from one grouping."""
    sides = [tables.read(spark, sf_dir, t).select(F.explode(P.words(F.col("text"))).alias("w"), F.lit(k).alias("side")) for t, k in (("benchmark", 1), ("documents", 2))]
    seen = sides[0].unionByName(sides[1]).groupBy("w").agg(F.bit_or("side").alias("sides"))
    return seen.agg(F.count_if(F.col("sides").bitwiseAND(1) > 0).alias("n_benchmark"), F.count_if(F.col("sides").bitwiseAND(2) > 0).alias("n_documents"), F.count("*").alias("n_union"), F.count_if(F.col("sides") == 3).alias("n_shared"), F.count_if(F.col("sides") == 1).alias("n_only"))


@query("SELECT user_id, count(DISTINCT s) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def session_idle_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity sessions that end after an hour without an event."""
    sessions = tables.read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "60 minutes")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("WITH k AS (SELECT user_id, max(ts) AS current FROM events GROUP BY user_id) SELECT e.event_type, count(*) FILTER (e.ts < k.current - INTERVAL 1 DAY) AS late, count(*) FILTER (e.ts >= k.current - INTERVAL 1 DAY) AS kept FROM events e JOIN k USING (user_id) GROUP BY ALL")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events more than a day behind their user's newest one."""
    events = tables.read(spark, sf_dir, "events")
    joined = events.join(events.groupBy("user_id").agg(F.max("ts").alias("current")), "user_id")
    late = F.col("ts") < F.col("current") - F.expr("interval 1 day")
    return joined.groupBy("event_type").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("kept"))


@query("SELECT doc_id, source, r FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 400")
def stratified_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 400 documents filled by turns from each source."""
    return reports.round_robin(tables.read(spark, sf_dir, "documents"), "source", "doc_id", 400).select("doc_id", "source", F.col("r").cast("long"))


@query("WITH n AS (SELECT n_nationkey, n_name FROM nation), s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) SELECT s_suppkey, n_name, c_custkey FROM (SELECT s.s_suppkey, n.n_name, c.c_custkey, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY abs(c.c_acctbal - s.s_acctbal), c.c_custkey) AS r FROM s JOIN n ON n.n_nationkey = s.s_nationkey JOIN customer c ON c.c_nationkey = s.s_nationkey) WHERE r = 1")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the customer of its nation with the nearest balance; the smaller key on ties."""
    s, n, c = (tables.read(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    own = s.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("at"), "s_suppkey")
    best = reports.nearest(own, c.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"), "c_custkey"), "nation", "at", "s_suppkey", "c_custkey")
    return best.where("c_custkey is not null").join(n, F.col("nation") == F.col("n_nationkey")).select("s_suppkey", "n_name", "c_custkey")


_URL = r"""(?:https?:)?//([A-Za-z0-9.-]+)"""


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(rf"WITH u AS (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '{_URL}', 1)) AS host FROM pages) SELECT lower(host) AS host, count(*) AS requests, count(DISTINCT page_id) AS pages, regexp_matches(lower(host), '^(?:localhost|127(?:\.{_OCTET}){{3}})$') AS loopback FROM u GROUP BY ALL")
def hosts_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that pages name, own-machine ones apart."""
    whole = F.concat_ws(" ", "url", "html")
    urls = tables.read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(whole, F.lit(_URL), F.lit(1))).alias("h")).select("page_id", F.lower("h").alias("host"))
    return urls.groupBy("host", masks.is_loopback(F.col("host")).alias("loopback")).agg(F.count("*").alias("requests"), F.countDistinct("page_id").alias("pages"))


_TAG_SQL = _re2(masks.TAG)


@query(f"SELECT page_id, length(html) AS n, md5(array_to_string(list_transform(list_zip(string_split_regex(html, '{_TAG_SQL}'), regexp_extract_all(html, '{_TAG_SQL}')), lambda p: p[1] || coalesce(regexp_replace(p[2], '[^\\n]', ' ', 'g'), '')), '')) AS masked FROM pages")
def html_mask_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their tags masked by as many spaces."""
    text = masks.masked(F.col("html"), masks.TAG)
    return tables.read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n"), F.md5(text).alias("masked"))


@query("SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '\\?\\s*$')) AS questions, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def turns_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("\\?\\s*$")).alias("questions"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query()
def reconcile_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ids kept, moved and new when each document loses its first sentence."""
    from textgate.streaming import identity

    sents = segment.sentences(documents(spark, sf_dir))
    # a sentence is in both revisions, but for the first, so that texts are cut once
    sides = F.explode(F.when(F.col("sent_idx") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return identity.matched_sides(sents.select("doc_id", "sent_idx", "sentence", "start", sides.alias("side"))).groupBy("state").agg(F.count("*").alias("n"))


# ---- spans, order and state


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '\\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT doc_id, count(DISTINCT run) AS n FROM r WHERE regexp_matches(line, '\\S') GROUP BY doc_id")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.paragraphs(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL} SELECT doc_id, sum(len(list_filter(string_split_regex(line, '[;|]|[.:?!](?:\\s|$)'), lambda c: regexp_matches(c, '[^\\s]'))))::BIGINT AS n FROM lines GROUP BY doc_id")
def clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.size(F.filter(segment.clauses(F.col("line")), lambda c: c.rlike("\\S")))
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.sum(full).alias("n"))


_SPANS_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), s AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(line) AS n FROM l)"


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their number and their offsets in the document."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.select("doc_id", (F.col("at") + 1).alias("i"), "line", start.alias("start")).withColumn("end", F.col("start") + F.length("line"))


@query(f"WITH {_SPANS_SQL}, p AS (SELECT doc_id, strpos(text, ' the ')::BIGINT AS offs FROM documents WHERE strpos(text, ' the ') > 0) SELECT p.doc_id, p.offs AS offs, s.start AS start, s.start + s.n AS end_ FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.start <= p.offs AND p.offs < s.start + s.n")
def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds a place in the document: spans in order, the last begun carried forward."""
    points = documents(spark, sf_dir).select("doc_id", F.instr("text", " the ").cast("long").alias("offs")).where("offs > 0")
    spans = line_spans(spark, sf_dir).select("doc_id", "start", F.col("end").alias("end_"))
    return reports.holding(points, spans, "doc_id", "offs", "start", "end_")


@query(f"WITH {_SPANS_SQL}, f AS (SELECT doc_id, length(line) + 1 AS cut FROM s WHERE i = 1) SELECT s.doc_id, count(*) AS kept, sum(s.start - f.cut)::BIGINT AS moved_to FROM s JOIN f USING (doc_id) WHERE s.i > 1 GROUP BY s.doc_id")
def reanchor_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line offsets carried through a change that takes the first line out."""
    rows = line_spans(spark, sf_dir)
    cut = F.first(F.when(F.col("i") == 1, F.length("line") + 1), True).over(Window.partitionBy("doc_id"))
    return rows.withColumn("cut", cut).where("i > 1").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.col("start") - F.col("cut")).alias("moved_to"))


@query("WITH o AS (SELECT doc_id, max(i) FILTER (n >= 80) AS last_long, max(i) AS last FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, length(unnest(string_split(text, chr(10)))) AS n FROM documents) GROUP BY doc_id) SELECT doc_id, (last - coalesce(last_long, 0))::BIGINT AS n FROM o")
def trailing_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines at a document's end are shorter than 80 characters."""
    rows = line_spans(spark, sf_dir)
    last = F.max(F.when(F.length("line") >= 80, F.col("i")))
    return rows.groupBy("doc_id").agg((F.max("i") - F.coalesce(last, F.lit(0))).cast("long").alias("n"))


@query("SELECT doc_id, arg_max(line, i) AS line, max(i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(line, '[0-9]') GROUP BY doc_id")
def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's last line with a digit."""
    rows = line_spans(spark, sf_dir).where(F.col("line").rlike("[0-9]"))
    return rows.groupBy("doc_id").agg(F.max_by("line", "i").alias("line"), F.max("i").cast("long").alias("i"))


@query("WITH t AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM t) SELECT source, string_agg(lang, ', ' ORDER BY k) FILTER (k <= 2) AS first, coalesce(sum(n) FILTER (k > 2), 0)::BIGINT AS rest FROM r GROUP BY source")
def first_groups_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return reports.first_and_rest(counts, "source", "lang", "n", 2)


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents WHERE source IS NOT NULL GROUP BY source")
def histogram_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(tables.read(spark, sf_dir, "documents"), "source").withColumn("rank", F.col("rank").cast("long"))


_CANON = ["fr", "en", "de"]


@query("SELECT lang, n, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, n DESC, lang) AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in a given order, the others behind by count and name."""
    counts = tables.read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    given = F.array_position(F.array(*[F.lit(x) for x in _CANON]), F.col("lang"))
    order = [F.asc(F.when(given > 0, given).otherwise(len(_CANON) + 1)), F.desc("n"), F.asc("lang")]
    return reports.placed(counts, order, "place").withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def newest_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 entries of each user."""
    return reports.top_n(tables.read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", F.col("rank").cast("long").alias("r"))


@query("SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL)) WHERE r <= 3")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once, as first seen, and the first three keys of a user in the order they came."""
    first = tables.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))
    return reports.top_n(first, ["user_id"], [F.asc("event_id")], 3).drop("rank")


@query("SELECT user_id, event_id, least(60 * power(2, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1), 600)::BIGINT AS hold_seconds FROM events")
def retry_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the next attempt waits after the r-th failure: a minute, doubled up to ten."""
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return tables.read(spark, sf_dir, "events").select("user_id", "event_id", F.least(60 * F.pow(F.lit(2.0), nth - 1), F.lit(600.0)).cast("long").alias("hold_seconds"))


@query("WITH r AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events), g AS (SELECT *, sum(CASE WHEN gap <= 15 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, run")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events whose numbers are at most 15 apart."""
    return reports.runs(tables.read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 15)


@query(f"WITH {PAIRS_SQL} SELECT line_no % 8 AS kind, sum(len(list_filter(string_split(source, ' '), lambda w: list_contains(string_split(candidate, ' '), w))))::BIGINT AS shared, sum(len(list_filter(string_split(candidate, ' '), lambda w: NOT list_contains(string_split(source, ' '), w))))::BIGINT AS new FROM pairs GROUP BY ALL")
def shared_and_new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the source that the candidate has, repeats counted, and words it has alone."""
    rows = pairs(spark, sf_dir).select((F.col("line_no") % 8).alias("kind"), F.split("source", " ").alias("a"), F.split("candidate", " ").alias("b"))
    shared, new = F.size("a") - relations.lacking(F.col("a"), F.col("b")), relations.lacking(F.col("b"), F.col("a"))
    return rows.groupBy("kind").agg(F.sum(shared).alias("shared"), F.sum(new).alias("new"))


@query("WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'), l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) SELECT o_custkey FROM (SELECT * FROM k UNION SELECT * FROM t) EXCEPT SELECT * FROM l")
def known_less_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with one of two priorities and without a large order, from one grouping."""
    known = F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("known")
    live = F.bool_or(F.col("o_totalprice") > 300000).alias("live")
    return tables.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(known, live).where("known and not live").select("o_custkey")


_STEM_SQL = "regexp_replace({w}, '^(.{{3,}}?)(?:" + "|".join(lex.SUFFIXES) + ")$', '\\1')"


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), d AS (SELECT w, count(*) AS n FROM w GROUP BY w) SELECT " + _STEM_SQL.format(w=_STEM_SQL.format(w="w")) + " AS stem, sum(n)::BIGINT AS n, count(*) AS forms FROM d GROUP BY 1")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by their stem: distinct words are stemmed once."""
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(relations.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'keep' ELSE 'rewrite' END AS action, CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'rewrite' END AS expected, doc_id % 5 > 1 AND n_chars > 500 AS surfaced, n_chars AS ms, lang = 'en' AS m FROM documents), s AS (SELECT *, action <> 'failed' AND expected = 'rewrite' AS p, action <> 'failed' AND expected = 'keep' AS c FROM r) SELECT count(*) FILTER (action <> 'failed') AS scored, count(*) FILTER (p) AS positives, count(*) FILTER (p AND surfaced) AS surfaced_on_positives, count(*) FILTER (p AND surfaced) / count(*) FILTER (p) AS recall, count(*) FILTER (c) AS cleans, count(*) FILTER (c AND surfaced) AS false_positives, count(*) FILTER (c AND surfaced) / count(*) FILTER (c) AS false_positive_rate, count(*) FILTER (action = 'failed') AS failures, count(*) FILTER (p AND surfaced AND m) AS surfaced_by_model, count(*) FILTER (p AND surfaced AND NOT m) AS surfaced_by_mechanics_only, quantile_disc(ms, 0.5) FILTER (action <> 'failed') AS latency_p50, quantile_disc(ms, 0.95) FILTER (action <> 'failed') AS latency_p95, max(ms) FILTER (action <> 'failed') AS latency_max FROM s")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a run whose rows are made from the documents."""
    k = F.col("doc_id") % 5
    rows = tables.read(spark, sf_dir, "documents").select(
        F.when(k == 0, "failed").when(k == 1, "keep").otherwise("rewrite").alias("action"),
        F.when(F.col("doc_id") % 3 == 0, "keep").otherwise("rewrite").alias("expectedAction"),
        ((k > 1) & (F.col("n_chars") > 500)).alias("surfaced"),
        F.col("n_chars").alias("milliseconds"),
        (F.col("lang") == "en").alias("by_model"),
        (F.col("lang") != "en").alias("by_mechanics"),
    )
    return reports.scored(rows)


@query("WITH c AS (SELECT doc_id AS key, CASE WHEN n_chars % 3 = 0 THEN 'accepted' ELSE 'refused' END AS bucket, CASE WHEN n_chars % 2 = 0 THEN 'accepted' ELSE 'refused' END AS was FROM documents), j AS (SELECT c.*, CASE l.toxic WHEN 1 THEN 'CHANGED' WHEN 0 THEN 'PRESERVING' END AS label FROM c LEFT JOIN labels l ON l.doc_id = c.key) SELECT CASE WHEN was = bucket THEN 'kept' WHEN bucket = 'accepted' THEN 'newly accepted' ELSE 'newly refused' END AS change, label, count(*) AS n, count(*) FILTER (label = 'CHANGED' AND bucket = 'accepted' AND was <> 'accepted') AS regressions FROM j GROUP BY ALL")
def verdicts_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts joined with labels and an earlier baseline."""
    docs = tables.read(spark, sf_dir, "documents")
    verdict = lambda n: F.when(F.col("n_chars") % n == 0, "accepted").otherwise("refused")
    labels = tables.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "CHANGED").otherwise("PRESERVING").alias("label"))
    current, baseline = docs.select(F.col("doc_id").alias("key"), verdict(3).alias("bucket")), docs.select(F.col("doc_id").alias("key"), verdict(2).alias("bucket"))
    return reports.classified(current, labels, baseline).groupBy("change", "label").agg(F.count("*").alias("n"), F.count_if("regression").alias("regressions"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rewrite' WHEN 2 THEN 'keep' ELSE NULL END AS action, CASE doc_id % 4 WHEN 0 THEN 'unknown action' WHEN 3 THEN 'invalid JSON' END AS error FROM documents")
def parsed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made from the documents' sources, parsed: thinking, fences, cut ends and broken ones."""
    body = lambda action: F.to_json(F.struct(F.lit(action).alias("action"), F.concat(F.lit("x"), F.coalesce("source", F.lit(""))).alias("replacement"), F.lit("r").alias("reason")))
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, body("drop")).when(k == 1, F.concat(F.lit("<think>hm {</think>```json\n"), body("rewrite"), F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"action":"keep","replacement":""'))).otherwise(F.lit("no JSON"))
    told = contract.decision(F.when(k == 2, contract.complete_json(reply)).otherwise(contract.strip_thinking(reply)))
    return tables.read(spark, sf_dir, "documents").select("doc_id", told["action"].alias("action"), told["error"].alias("error"))


@query()
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stretches of a line a rewrite touches, and how long they are."""
    rows = pairs(spark, sf_dir).withColumn("ops", guards.edit_ops(F.col("source"), F.col("candidate")))
    rows = rows.withColumn("ranges", guards.changed_ranges(F.col("source"), F.col("ops")))
    length = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return rows.groupBy((F.col("line_no") % 8).alias("kind")).agg(F.sum(F.size("ranges")).alias("ranges"), F.sum(length).alias("chars"))


# ---- explanations, projection, claims, and the state of requests


@query()
def edit_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changes of lines are called, by the first word of the explanation."""
    rows = pairs(spark, sf_dir).withColumn("ops", guards.edit_ops(F.col("source"), F.col("candidate")))
    said = explain.explained(F.col("ops"), F.col("source"), F.col("candidate"))
    parts = F.size(explain.diff_parts(F.col("ops")))
    rows = rows.select((F.col("line_no") % 8).alias("kind"), F.substring_index(said, " ", 1).alias("verb"), parts.alias("parts"))
    return rows.groupBy("kind", "verb").agg(F.count("*").alias("n"), F.sum("parts").alias("parts"))


@query()
def projected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of marked-up lines carried back to the source: lines, edits, and how many then read as the rewrite."""
    rows = pairs(spark, sf_dir)
    rows = rows.withColumn("marked", F.concat(F.lit("> "), F.regexp_replace("source", "^([^ ]+) ([^ ]+)", "**$1** [$2](x)")))
    rows = rows.withColumn("edits", markdown.source_edits(F.col("marked"), F.col("candidate")))
    rows = rows.withColumn("again", markdown.projection(markdown.applied(F.col("marked"), F.col("edits"))))
    return rows.groupBy((F.col("line_no") % 8).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.size("edits")).alias("edits"), F.count_if(F.col("again.text") == F.col("candidate")).alias("exact"))


CLAIMED = ["This is a seamless tool", "Setup takes 5 minutes", "Zero false positives on the corpus", "It is perfect", "AI-powered text", "Metal was measured", "Plain"]


@query()
def claim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in documents with a claim, and in a third of them a waiver, before their text."""
    docs = documents(spark, sf_dir)
    claim = F.get(F.array(*[F.lit(c) for c in CLAIMED]), (F.col("doc_id") % len(CLAIMED)).cast("int"))
    waiver = F.when(F.col("doc_id") % 3 == 0, "<!-- forbidden-phrases: allow marketing/boast, absolute/perfection - quoted -->\n").otherwise("")
    text = F.concat(waiver, claim, F.lit(".\n"), F.coalesce("text", F.lit("")))
    return claims.findings(docs.select("doc_id", text.alias("text"))).groupBy("rule", "waived").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("WITH r AS (SELECT doc_id % 3 <> 0 AS remit, CASE WHEN n_chars % 2 = 0 THEN 'hide' ELSE 'show' END AS expected, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'error' WHEN 2 THEN 'show' ELSE 'hide' END AS got FROM documents) SELECT count(*) FILTER (remit AND expected = 'hide' AND got = 'hide') AS caught, count(*) FILTER (remit AND expected = 'hide') AS hides, count(*) FILTER (remit AND expected = 'show' AND got = 'hide') AS false_hides, count(*) FILTER (remit AND expected = 'show') AS shows, count(*) FILTER (got IS NULL OR got NOT IN ('show', 'hide')) AS unavailable, count(*) FILTER (NOT remit AND got = 'hide') AS outside_hide, count(*) FILTER (NOT remit AND got = 'show') AS outside_show, count(*) FILTER (NOT remit AND (got IS NULL OR got NOT IN ('show', 'hide'))) AS outside_unavailable FROM r")
def verifier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verifier's answers, made from the documents, against the labels."""
    k = F.col("doc_id") % 5
    got = F.when(k == 0, None).when(k == 1, "error").when(k == 2, "show").otherwise("hide")
    rows = tables.read(spark, sf_dir, "documents").select((F.col("doc_id") % 3 != 0).alias("inRemit"), F.when(F.col("n_chars") % 2 == 0, "hide").otherwise("show").alias("expected"), got.alias("got"))
    return reports.verifier_summary(rows)


@query()
def rescored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run recorded over the pairs, judged again, by recorded and new action."""
    rows = pairs(spark, sf_dir)
    was = F.col("doc_id") % 4
    run = rows.select(
        "source",
        F.when(was != 1, F.col("candidate")).otherwise("").alias("replacement"),
        F.when(was == 1, F.col("candidate")).alias("rejectedText"),
        F.when(was == 0, "failed").when(was == 1, "keep").otherwise("rewrite").alias("action"),
        F.when(was == 1, "verifier-hidden").alias("rejection"),
        F.lit(None).cast("string").alias("modelRejection"),
        (was == 2).alias("by_model"),
        F.lit(False).alias("by_rule"),
    )
    new = reports.rescored(run)
    return new.groupBy("action", "rejection", "surfaced").agg(F.count("*").alias("n"))


_EVENT_SQL = "e AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'sentence' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'remove' ELSE 'dismiss' END AS kind, 't' || (event_id % 3) AS text FROM events)"


@query(f"WITH {_EVENT_SQL}, s AS (SELECT *, max(CASE WHEN kind = 'set' THEN seq END) OVER w AS ss, max(CASE WHEN kind = 'dismiss' THEN seq END) OVER w AS ds FROM e WINDOW w AS (PARTITION BY id ORDER BY seq)), l AS (SELECT s.id, s.seq, s.kind, s.text, s.ss, s.ds, a.text AS st, b.text AS dt FROM s LEFT JOIN e a ON a.id = s.id AND a.seq = s.ss LEFT JOIN e b ON b.id = s.id AND b.seq = s.ds), g AS (SELECT id, max(ss) AS ss, max(ds) AS ds, max(CASE WHEN kind IN ('remove', 'dismiss') OR (kind = 'sentence' AND st <> text) THEN seq END) AS se, max(CASE WHEN kind = 'sentence' AND dt <> text THEN seq END) AS de FROM l GROUP BY id) SELECT g.id, CASE WHEN se IS NULL OR ss > se THEN a.text END AS suggested, CASE WHEN de IS NULL OR ds > de THEN b.text END AS dismissed FROM g LEFT JOIN e a ON a.id = g.id AND a.seq = g.ss LEFT JOIN e b ON b.id = g.id AND b.seq = g.ds")
def live_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions and dismissals that a user's events leave."""
    kind = F.when(F.col("event_type") == "view", "sentence").when(F.col("event_type").isin("click", "purchase"), "set").when(F.col("event_type") == "error", "remove").otherwise("dismiss")
    rows = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("text"))
    return requests.live_suggestions(rows)


@query("WITH r AS (SELECT user_id AS id, event_id AS seq, event_type AS text, event_id % 4 AS priority, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY seq) AS entry FROM r), g AS (SELECT id, entry, min(seq) AS since, arg_max(priority, seq) AS priority, count(*) AS n, min(text) AS text FROM n GROUP BY id, entry) SELECT id, entry::BIGINT AS entry, since, priority, n, text, lead(since) OVER (PARTITION BY id ORDER BY entry) AS superseded FROM g")
def request_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's equal requests in a row as one entry, and what supersedes it."""
    rows = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), (F.col("event_id") % 4).alias("priority"))
    return requests.entries(rows, same=("text",)).withColumn("entry", F.col("entry").cast("long"))


@query("WITH r AS (SELECT user_id AS id, event_id AS seq, event_type AS text, event_id % 4 AS priority, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY seq) AS entry FROM r), g AS (SELECT id, entry, min(seq) AS since, arg_max(priority, seq) AS priority, min(text) AS text FROM n GROUP BY id, entry), l AS (SELECT *, lead(since) OVER (PARTITION BY id ORDER BY entry) AS superseded FROM g) SELECT id, since, priority FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, since) AS rank FROM l WHERE text <> 'error') WHERE rank <= 2")
def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two entries of each user that are served next."""
    rows = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), (F.col("event_id") % 4).alias("priority"))
    open_ = requests.entries(rows, same=("text",)).where("text <> 'error'")
    return requests.served(open_, "id", 2).select("id", "since", "priority")


@query()
def outcome_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit keys of benchmark items with their source as the term."""
    items = tables.read(spark, sf_dir, "benchmark")
    return items.select("item_id", P.outcome_key(F.col("text"), F.array(F.lit("term"))).alias("key"))
