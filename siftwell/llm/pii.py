"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and
identifier cues; deterministic parsers expand each anchor to the left and right and validate what they find.

Base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping matches of their patterns, without
those that fail validation: the expansion starts at the first character from which a match can begin, and a
failed match is passed over whole. The method adds iban (mod-97 checked accounts), secret (values after
password, token and like cues) and url (addresses that carry a user's name and password).

Defined cases: a null or empty text has no spans; a null doc_id is kept; repeated rows are judged one by one;
an empty table gives an empty result; other columns are ignored by find_pii and kept by redact. Time is linear
in the text: runs between anchors of a kind are read once, values that turn out to be no secret included.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

from pyspark.sql import DataFrame

from siftwell.llm.common import hold, map_rows, require, table

#: The contract's patterns, split at their anchors.
BASE_KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]+")

ADDED_KINDS = ("iban", "secret", "url")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?")
SECRET = re.compile(r"[^\s\"',;]+")
MIN_SECRET = 8
CREDENTIALS = re.compile(r"[^\s/@:]{1,64}:[^\s/@]{1,64}@[A-Za-z0-9.-]+(?::[0-9]+)?")
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key")


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", "u")
    for d in "0123456789":
        a.add_word(d, "d")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, "s")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind, in order; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS + ADDED_KINDS}
    if not text:
        return found
    email_from = ip_from = card_from = phone_from = secret_from = plain_to = url_from = iban_from = 0
    for end, what in automaton().iter(text):
        if what == "d":
            if end >= ip_from:
                if m := IP.match(text, end):
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:
                    ip_from = DIGITS.match(text, end).end()
            if end >= card_from:
                if m := CARD.match(text, end):
                    card_from = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                else:
                    card_from = end + 1
            if end - 2 >= iban_from and text[end - 2 : end].isalpha() and not text[end - 3 : end - 2].isalnum():
                if (m := IBAN.match(text, end - 2)) and iban_valid(m[0]):
                    found["iban"].append(m.span())
                    iban_from = m.end()
        elif what == "@":
            if end >= email_from:
                start = end
                while start > email_from and text[start - 1] in LOCAL:
                    start -= 1
                if start < end and (m := DOMAIN.match(text, end + 1)):
                    email_from = m.end()
                    found["email"].append((start, email_from))
        elif what == "+":
            if end >= phone_from and (m := PHONE.match(text, end)):
                phone_from = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append(m.span())
        elif what == "s":
            # a run without digits is read once: values that begin further on in it hold none either
            if end >= secret_from and (m := ASSIGNED.match(text, end + 1)) and m.end() >= plain_to and (m := SECRET.match(text, m.end())):
                if not any(map(str.isdigit, m[0])):
                    plain_to = m.end()
                elif m.end() - m.start() >= MIN_SECRET:
                    secret_from = m.end()
                    found["secret"].append(m.span())
        elif end >= url_from and (m := CREDENTIALS.match(text, end + 1)):
            start = end - 2
            while start > url_from and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
            url_from = m.end()
            found["url"].append((start, url_from))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, found in find_spans(text).items() for a, b in found)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]]) if out else text


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _digest(doc_id, text):
    found = find_spans(text)
    base = joined(found, BASE_KINDS)
    return (doc_id, *(len(found[k]) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(found, BASE_KINDS + ADDED_KINDS))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    require(docs, "doc_id", "text")
    return map_rows(docs, SCHEMA, _digest, "doc_id", "text")


def _redact_batches(batches):
    import pyarrow as pa

    hold("rows")
    for b in batches:
        at = b.schema.get_field_index("text")
        new = pa.array([redacted(x) for x in b.column(at).to_pylist()], type=b.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced; all rows and columns stay."""
    require(docs, "text")
    return docs.mapInArrow(_redact_batches, docs.schema)


def op2_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
