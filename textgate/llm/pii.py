"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, URL schemes, digits after
dots or alone, and cue words such as "account", schemes and cues in any case.  Each anchor has a local parser that walks
outwards over the characters its kind allows and validates what it meets (label rules, octet
range, Luhn sum, digit counts, mod-97).  Parsers read a bounded neighbourhood or the run they
are in, so a text costs time in proportion to its length.

Kinds ``email``, ``ip``, ``card`` and ``phone`` follow fixed base patterns, leftmost and
non-overlapping within a kind; ``url``, ``iban`` and ``account`` are added by this method.

Defined cases: a null or empty text has no spans; rows are read one by one, so repeated rows
and ties get equal results; very long texts are read whole, in time in proportion to them; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
# Characters of base patterns and cues.
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "mailto:")
CUES = ("account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
#: Cues whose value is a secret whatever it looks like, and cues of everyday words, whose value must look like one.
SECRETS = ("api_key", "api-key", "api key", "apikey", "access_key", "access-key", "access key", "private_key", "private-key", "password", "passwd", "passphrase", "pwd")
HINTS = ("token", "secret", "credential", "authorization", "bearer")
_LOWER = {k: k + 32 for k in range(65, 91)}
URL_STOP = frozenset(" \t\n\r\x0b\x0c<>\"'|\\^`{}")
MASKS = {k: f"<{k.upper()}>" for k in (*BASE, *ADDED)}

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in sorted(DIGITS)), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES), *((c, "secret") for c in SECRETS), *((c, "hint") for c in HINTS)]:
        found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expands an at-sign to its mailbox and a domain of two labels or more; nothing before ``floor`` is used."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while text[end : end + 1] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = after, dots + 1
    return (start, end) if dots else None


def dotted(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """From the first digit of a run: where its dotted digit groups end, and each four groups of them."""
    ends, starts, end = [], [at], _run(text, at, DIGITS)
    ends.append(end)
    while text[end : end + 1] == "." and (after := _run(text, end + 1, DIGITS)) > end + 1:
        starts.append(end + 1)
        ends.append(after)
        end = after
    return end, [(starts[k], ends[k + 3]) for k in range(0, len(starts) - 3, 4)]


def octets(text: str) -> bool:
    return all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in text.split("."))


def card_run(text: str, at: int) -> int:
    """The end of digits with at most one space or hyphen between two of them."""
    end = at + 1
    while True:
        if text[end : end + 1] in DIGITS and end < len(text):
            end += 1
        elif text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in DIGITS and end + 1 < len(text):
            end += 2
        else:
            return end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def phone(text: str, at: int) -> tuple[int, int] | None:
    """Expands a plus sign to a digit, a run of phone characters and a last digit."""
    if text[at + 1 : at + 2] not in DIGITS or at + 1 >= len(text):
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def url(text: str, at: int, length: int) -> tuple[int, int] | None:
    """Expands a scheme to the end of the address, without closing punctuation."""
    end = at + length
    while end < len(text) and text[end] not in URL_STOP:
        end += 1
    while end > at + length and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (at, end) if end > at + length else None


_WORD = r"(?:[ \t]{0,3}(?:number|no|nr|num|id|key|is|#))?"
_HEAD = re.compile(_WORD + r"[ \t]{0,3}[.:=#]?[ \t]{0,3}(?=[A-Za-z0-9])", re.ASCII | re.IGNORECASE)
_NAME = r"(?:[_ -]?(?:key|id|token|value|secret|code|hash|string|phrase))?s?"
_GIVEN = re.compile(f"(?:{_NAME}|{_WORD})" + r"[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"']?", re.ASCII | re.IGNORECASE)
_BORNE = re.compile(r"[ \t]{1,3}[\"']?")
VALUE = DIGITS | LETTERS | frozenset("_-")
SECRET_STOP = frozenset(" \t\n\r\x0b\x0c<>\"'`,;")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


def account(text: str, after: int, dead: int) -> tuple[int, int, bool] | None:
    """The run of identifier characters that follows a cue, and whether it has four digits or more; none before ``dead``."""
    m = _HEAD.match(text, after)
    if not m or m.end() < dead:
        return None
    end = _run(text, m.end(), VALUE)
    return m.end(), end, sum(c in DIGITS for c in text[m.end() : end]) >= 4


def secret(text: str, after: int, plain: bool, dead: int) -> tuple[int, int, bool] | None:
    """What stands after a cue and a colon or equals sign, up to blank or quote, and whether it counts: four characters or more of any kind.

    After an everyday word the value must have eight characters and a digit, and start at ``dead`` or later; one that
    follows it without a sign, as a bearer's does, must have sixteen.
    """
    given = _GIVEN.match(text, after)
    if not (m := given or (plain and _BORNE.match(text, after))) or (plain and m.end() < dead):
        return None
    start = end = m.end()
    while end < len(text) and text[end] not in SECRET_STOP:
        end += 1
    whole = end
    while end > start and text[end - 1] in ".:!?)]}":
        end -= 1
    if not plain:
        return (start, end, True) if end >= start + 4 else None
    digit = any(c in DIGITS for c in text[start:end])
    return (start, end, True) if digit and end >= start + (8 if given else 16) else (start, start if digit else whole, False)


def iban(text: str, digit: int) -> tuple[int, int] | None:
    """A country code, check digits and account that pass mod 97, from the first check digit."""
    if digit < 2 or text[digit - 1] not in LETTERS or text[digit - 2] not in LETTERS or (digit > 2 and text[digit - 3].isalnum()):
        return None
    m = _IBAN.match(text, digit - 2)
    if not m:
        return None
    # capital words behind the account are not part of it: the longest whole groups that pass count
    end = m.end()
    while end - m.start() >= 15:
        code = text[m.start() : end].replace(" ", "")
        if len(code) >= 15 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return m.start(), end
        end = text.rfind(" ", m.start(), end)
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    past = dict.fromkeys(found, 0)  # no span of a kind starts before the last one's end
    seen_dotted = seen_card = dead = plain = 0
    # of the same length, whatever lower() makes of other letters
    for last, (kind, length) in anchors.iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        at = last - length + 1
        if kind == "digit":
            if at >= seen_dotted:
                seen_dotted, groups = dotted(text, at)
                found["ip"] += [(a, b) for a, b in groups if octets(text[a:b])]
            if at >= seen_card:
                seen_card = card_run(text, at)
                if seen_card - at >= 16 and 16 <= len(digits := text[at:seen_card].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found["card"].append((at, seen_card))
            if at >= past["iban"] and (hit := iban(text, at)):
                found["iban"].append(hit)
                past["iban"] = hit[1]
        elif kind == "at":
            if hit := email(text, at, past["email"]):
                found["email"].append(hit)
                past["email"] = hit[1]
        elif kind == "plus":
            if at >= past["phone"] and (hit := phone(text, at)):
                past["phone"] = hit[1]
                if 8 <= sum(c in DIGITS for c in text[at : hit[1]]) <= 15:
                    found["phone"].append(hit)
        elif kind == "scheme":
            if at >= past["url"] and (hit := url(text, at, length)):
                found["url"].append(hit)
                past["url"] = hit[1]
        elif at >= past["account"]:
            hit = None
            if kind != "cue" and (run := secret(text, last + 1, kind == "hint", plain)):
                # a later cue in a run without a digit has none after it either
                hit, plain = (run[:2], plain) if run[2] else (None, run[1])
            if not hit and kind != "hint" and (run := account(text, last + 1, dead)):
                # what follows a later cue in a run with too few digits has too few as well
                hit, dead = (run[:2], dead) if run[2] else (None, run[1])
            if hit:
                found["account"].append(hit)
                past["account"] = hit[1]
    return [(k, a, b) for k, pairs in found.items() for a, b in pairs]


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span, or each union of overlapping ones, replaced by its first kind's mask."""
    out, done = [], 0
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], MASKS[k]]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


RESULT = ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, masked string"


def _searched(docs: DataFrame, text: str, keep: tuple[str, ...], mask: bool) -> DataFrame:
    """The ``keep`` columns as ``keep_0``, ``keep_1``, ... and the result, so that no name of a table clashes."""
    kept = [f"keep_{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text).alias("text"))
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in kept), RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in _words.slices(batch, limit=8 << 20):
                rows: list[tuple] = []
                for value in part.column("text").to_pylist():
                    value = value or ""
                    every = spans(value, anchors) if value else []
                    base = [s for s in every if s[0] in BASE]
                    counts = [sum(s[0] == k for s in base) for k in BASE]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), masked(value, every) if mask else None))
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([*(part.column(k) for k in kept), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=[*kept, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "masked"])

    return df.mapInArrow(run, schema)


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask: bool = False) -> DataFrame:
    """The ``keep`` columns and each text's counts, base digest, spans and, on request, its masked form."""
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", *(["masked"] if mask else [])]
    return _searched(docs, text, keep, mask).select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *names)


def mask_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with personal data masked and their character counts brought up to date; columns of any name stay."""
    others = tuple(c for c in docs.columns if c not in (text, n_chars))
    out = _searched(docs, text, others, mask=True)
    values = {text: F.col("masked"), n_chars: F.length("masked").cast("long")}
    return out.select(*[values[c].alias(c) if c in values else F.col(f"keep_{others.index(c)}").alias(c) for c in docs.columns])
