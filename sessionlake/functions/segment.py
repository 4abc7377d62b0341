"""The segmenting analyser: dictionary words in CJK runs, folded words elsewhere, with Porter stems beside them.

CJK runs are cut by the most probable path through the graph of a lexicon's words, with words that it lacks discovered (:mod:`lexicon`); documents get the shorter words inside
a word too, and the pairs of characters that no word covers. Other runs are letters and digits, folded and
lower-cased; a stem that differs from its word is emitted at the same place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from .lexicon import Lexicon
from .text import fold_py

TOKEN_TYPE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("colocated", T.BooleanType())]))


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    colocated: bool = False


def is_cjk(c: str) -> bool:
    n = ord(c)
    return 0x3400 <= n <= 0x9FFF or 0xF900 <= n <= 0xFAFF or 0x3040 <= n <= 0x30FF or 0xAC00 <= n <= 0xD7AF or 0x20000 <= n <= 0x323AF


class Segmenter:
    def __init__(self, words: Lexicon | Mapping[str, int] | Iterable[str] = (), stem: bool = True):
        self.words, self.stem = words if isinstance(words, Lexicon) else Lexicon(words), stem

    def tokens(self, text: str, query: bool = False) -> list[Token]:
        out, i = [], 0
        while i < len(text):
            c = text[i]
            if is_cjk(c):
                j = i
                while j < len(text) and is_cjk(text[j]):
                    j += 1
                out += self._cjk(text[i:j], i, query)
            elif unicodedata.category(c)[0] in "LN":
                j = i
                while j < len(text) and not is_cjk(text[j]) and (unicodedata.category(text[j])[0] in "LN" or unicodedata.combining(text[j])):
                    j += 1
                word = fold_py(text[i:j])
                out.append(Token(word, i, j))
                root = porter(word) if self.stem and word.isascii() and word.isalpha() else word
                if root != word:
                    out.append(Token(root, i, j, True))
            else:
                j = i + 1
            i = j
        return out

    def _cjk(self, run: str, at: int, query: bool) -> list[Token]:
        out = []
        for i, j in self.words.cut(run):
            out.append(Token(run[i:j], at + i, at + j))
            if query:
                continue
            if j > i + 1:
                inner = sorted({(a, b) for a in range(i, j) for b, _ in self.words.ends(run[:j], a) if b > a + 1} - {(i, j)})
                out += [Token(run[a:b], at + a, at + b, True) for a, b in inner]
            elif j < len(run):
                out.append(Token(run[i : j + 1], at + i, at + j + 1, True))
        return out

    def column(self, text: Column, query: bool = False) -> Column:
        @F.pandas_udf(TOKEN_TYPE)
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [(x.text, x.start, x.end, x.colocated) for x in self.tokens(t or "", query)])

        return cut(text)


#: The suffix tables of the published Porter algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(w: str) -> str:
    """The stem of an English word."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = next((s for s in sorted(table, key=len, reverse=True) if w.endswith(s)), None)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = next((s for s in sorted(STEP4, key=len, reverse=True) if w.endswith(s)), None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
