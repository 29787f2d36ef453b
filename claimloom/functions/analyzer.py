"""The text analyser of the lexical index: tokens, synonyms, possessives, stop words, stems."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The default English stop words of the public Lucene library.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# Groups of equal words, US and British spelling and -ise and -ize forms.
SYNONYM_GROUPS = [
    ["tyre", "tire"],
    ["tyres", "tires"],
    ["fibre", "fiber"],
    ["fibres", "fibers"],
    ["aluminium", "aluminum"],
    ["centre", "center"],
    ["centred", "centered"],
    ["mould", "mold"],
    ["moulded", "molded"],
    ["moulding", "molding"],
    ["colour", "color"],
    ["coloured", "colored"],
    ["behaviour", "behavior"],
    ["sulphur", "sulfur"],
    ["gauge", "gage"],
    ["vulcanise", "vulcanize"],
    ["vulcanised", "vulcanized"],
    ["vulcanisation", "vulcanization"],
    ["polymerise", "polymerize"],
    ["polymerised", "polymerized"],
    ["polymerisation", "polymerization"],
    ["stabilise", "stabilize"],
    ["stabilised", "stabilized"],
]
TOKEN = r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def canonical_synonyms(groups: list[list[str]]) -> dict[str, str]:
    """Each single-word member of a group -> the group's first word. Several groups that share a word become one."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for group in groups:
        for other in group[1:]:
            a, b = find(group[0]), find(other)
            if a != b:
                root[b] = a
    return {w: find(w) for w in list(root) if find(w) != w}


def analyze(c: Column, synonyms: dict[str, str] | None = None, stem: bool = True) -> Column:
    """array<string> of index terms; the order of steps is tokens, lower case, synonyms, possessives, stop words, stems."""
    terms = tokens(c)
    if synonyms:
        table = F.create_map(*[F.lit(x) for pair in sorted(synonyms.items()) for x in pair])
        # a lookup in the map passes all its keys; most terms are none of them, which a set tells at once
        terms = F.transform(terms, lambda t: F.when(t.isin(sorted(synonyms)), F.try_element_at(table, t)).otherwise(t))
    terms = F.transform(terms, lambda t: F.regexp_replace(t, "['’]s$", ""))
    terms = F.filter(terms, lambda t: ~t.isin(STOP_WORDS) & (t != ""))
    return stem_all(terms) if stem else terms


def analyze_text(text: str, synonyms: dict[str, str] | None = None, stem: bool = True) -> list[str]:
    """As analyze, of one text on the driver: a keyword is analysed once, not for each row it is compared with."""
    terms = [regex.sub("['’]s$", "", (synonyms or {}).get(t, t)) for t in regex.findall(TOKEN, (text or "").lower())]
    return [porter(t) if stem else t for t in terms if t and t not in STOP_WORDS]


@F.arrow_udf(ArrayType(StringType()))
def stem_all(arrays: pa.Array) -> pa.Array:
    """Stems of the elements; each distinct word of a batch is stemmed once."""
    words = arrays.flatten().dictionary_encode()
    stems = pa.array([porter(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(arrays), 0)), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), stems, mask=arrays.is_null())


_V = "aeiou"


def _measure(word: str) -> str:
    """The word as a string of c and v; y is a vowel after a consonant."""
    kinds = ""
    for i, ch in enumerate(word):
        kinds += "v" if ch in _V or (ch == "y" and i > 0 and kinds[-1] == "c") else "c"
    return kinds


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _measure(stem)))


def _cvc(stem: str) -> bool:
    return len(stem) >= 3 and _measure(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(200_000)
def porter(word: str) -> str:
    """Porter's 1980 algorithm, from its published description."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _measure(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _measure(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _measure(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _m(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _m(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
