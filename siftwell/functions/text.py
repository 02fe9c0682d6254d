"""Text functions as Spark expressions: tokens, words, sentences, n-grams, globs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokeniser's pattern, the sentence break, sensitive terms and language cues.
TOKEN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
#: The characters of SPACE but for the space and the line feed: ASCII ones and others.
ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
ODD_WIDE = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """The text's tokens, casefolded. Only a capital I with a dot and a capital sigma fold otherwise in a whole text than
    in a token by itself, so a text without them is folded at once."""
    found = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    one_by_one = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u03a3"))
    return F.when(one_by_one, F.transform(found(text), casefold)).otherwise(found(casefold(text)))


def joined_tokens(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def words(text: Column) -> Column:
    """The text split at Unicode white space; no empty words.

    Where spaces and line feeds are all its white space, it is split at one character, which takes no regular expression
    and a fraction of the time.
    """
    has = lambda chars: reduce(or_, (F.contains(text, F.lit(c)) for c in chars))
    ascii_only = F.octet_length(text) == F.length(text)
    odd = has(ODD_ASCII) | F.when(ascii_only, F.lit(False)).otherwise(has(ODD_WIDE))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(odd, F.split(text, SPACE)).otherwise(plain), "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping word windows; the last one is the first that reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size is above 0 and overlap is from 0 to below size")
    stride = size - overlap

    def cut(w):
        last = F.when(F.size(w) <= size, F.lit(0)).otherwise(F.ceil((F.size(w) - size) / stride).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * stride + 1, size), " "))
        return F.when(F.size(w) > 0, parts).otherwise(F.array().cast("array<string>"))

    # the words as a lambda's variable: an expression would split the text again for every window
    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def sentences(text: Column, least_tokens: int = 5) -> Column:
    parts = F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.btrim(s, F.lit(" -\t")))
    return F.filter(parts, lambda s: F.size(tokens(s)) >= least_tokens)


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbours in an array of tokens."""
    n = F.size(t)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def contains_normalised(text: Column, claim: Column) -> Column:
    """Whether the claim's joined tokens are a substring of the text's; an empty claim always is."""
    return F.contains(joined_tokens(text), joined_tokens(claim))


def glob_pattern(pattern: str) -> str:
    """Anchored regular expression of a glob in which * crosses slashes; case matters."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(glob_pattern(p))
    return out
