"""Text functions: analysis, white space, escaping, headers, snippets, language, stems."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
HOP_HEADERS = ("transfer-encoding", "content-encoding", "content-length", "connection", "keep-alive")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def squash(text: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def default_title(title: Column, text: Column) -> Column:
    return F.coalesce(F.when(title != "", title), F.substring(text, 1, 80))


_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_escape(text: Column) -> Column:
    for plain, coded in _ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def html_unescape(text: Column) -> Column:
    for plain, coded in reversed(_ENTITIES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def urlencode(text: Column) -> Column:
    """Percent-encodes all but RFC 3986's unreserved characters; a space is %20."""
    coded = F.url_encode(text)
    for form, strict in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(form), F.lit(strict))
    return coded


def header_value(head: Column, name: str) -> Column:
    """Value of the first header of that name, any case, trimmed; null without one."""
    found = F.regexp_extract(head, rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*?)[ \t\r]*$", 1)
    return F.when(F.regexp_like(head, F.lit(rf"(?im)^{re.escape(name)}:")), found)


def first_header(headers: Column, name: str) -> Column:
    """The same from an array of (k, v), in which a name may recur."""
    return F.get(F.filter(headers, lambda h: F.lower(h["k"]) == name.lower()), F.lit(0))["v"]


def strip_hop_headers(headers: Column, length: Column) -> Column:
    """Archived headers: without those of the connection, values on one line, the body's length last."""
    kept = F.filter(headers, lambda h: ~F.lower(h["k"]).isin(*HOP_HEADERS))
    flat = F.transform(kept, lambda h: F.struct(h["k"].alias("k"), F.regexp_replace(h["v"], r"[\r\n]", " ").alias("v")))
    return F.concat(flat, F.array(F.struct(F.lit("content-length").alias("k"), length.cast("string").alias("v"))))


def lead_snippet(text: Column, width: int = 200) -> Column:
    """The fallback snippet: the first characters, escaped."""
    return F.concat(html_escape(F.substring(text, 1, width)), F.when(F.length(text) > width, "…").otherwise(""))


def snippet(text: Column, terms: list[str], width: int = 200) -> Column:
    """The window of up to width characters with the most distinct terms, marked with <b>, escaped."""
    wanted = frozenset(t.lower() for t in terms)

    @F.arrow_udf("string")
    def best(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _best_window(t, wanted, width) for t in texts.to_pylist()], pa.string())

    return best(text)


def _best_window(text: str, wanted: frozenset[str], width: int) -> str:
    hits = [m.span() for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in wanted]
    if not hits:
        return _escape(text[:width]) + ("…" if len(text) > width else "")
    best, left = (0, 0, 0), 0
    for right, (_, end) in enumerate(hits):
        while end - hits[left][0] > width and left < right:
            left += 1
        distinct = len({text[a:b].lower() for a, b in hits[left : right + 1]})
        if distinct > best[0]:
            best = (distinct, left, right)
    _, a, b = best
    start = max(0, hits[a][0] - (width - (hits[b][1] - hits[a][0])) // 2)
    stop = min(len(text), start + width)
    out, at = [], start
    for x, y in hits:
        if x >= start and y <= stop:
            out += [_escape(text[at:x]), "<b>", _escape(text[x:y]), "</b>"]
            at = y
    return "".join(out) + _escape(text[at:stop])


def _escape(s: str) -> str:
    for plain, coded in _ENTITIES:
        s = s.replace(plain, coded)
    return s


# Stemming: English suffix stripping in the manner of Porter's second algorithm, memoised by word.
_VOWEL = "aeiouy"


@lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    w = word.replace("'s", "").replace("'", "")
    r1 = _region(w, 0)
    if w[:5] in ("gener", "arsen") or w[:6] == "commun":
        r1 = 6 if w[:6] == "commun" else 5
    r2 = _region(w, r1)
    for a, b in (("sses", "ss"), ("ied", "i" if len(w) > 4 else "ie"), ("ies", "i" if len(w) > 4 else "ie")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    else:
        if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
            w = w[:-1]
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                base = w[: -len(s)]
                if any(c in _VOWEL for c in base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                        w = w[:-1]
                    elif len(w) <= r1 and _short(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] == "y" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")) and (s != "ogi" or w[-4:-3] == "l"):
                w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w


def _region(w: str, at: int) -> int:
    for i in range(at + 1, len(w)):
        if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
            return i + 1
    return len(w)


def _short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-3] not in _VOWEL and w[-2] in _VOWEL and w[-1] not in _VOWEL + "wx"


_STEP2 = sorted({"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}.items(), key=lambda x: -len(x[0]))
_STEP3 = sorted({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}.items(), key=lambda x: -len(x[0]))
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=lambda s: -len(s))


# Language: the commonest function words of sixteen languages.
_FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be at by this", "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine",
    "fr": "le la les de des et en un une du que qui dans pour est pas sur au", "es": "el la los las de que y en un una por con no para se del al es",
    "it": "il lo la gli di che e un una per con non sono del della è i le", "pt": "o a os as de que e em um uma para com não do da se no na",
    "nl": "de het een van en in is dat op te voor met zijn niet aan er om die", "sv": "och att det som en på är av för med den till inte om ett har de i",
    "da": "og det at en den til er som på de med han af for ikke der var et", "no": "og det er på som en til med for av ikke at jeg har de vi den et",
    "fi": "ja on ei se että oli hän mutta niin kun ovat myös sen joka tämä kuin", "pl": "i w na z się nie do to jest że o jak po za od przez dla był",
    "cs": "a v se na je že s z o do to k za jako by pro ale po", "ro": "și de în a la cu nu o că pe din care este un pentru sau mai se",
    "hu": "a az és hogy nem is egy ez azt volt de meg csak van már még mint el", "tr": "ve bir bu da de için ile o çok ne gibi daha var ama en olarak kadar mi",
}


def guess_language(words: list[str]) -> str | None:
    """The language of the most function words among the words; null where none occurs."""
    held = _function_words()
    score: dict[str, int] = {}
    for w in words:
        for lang in held.get(w, ()):
            score[lang] = score.get(lang, 0) + 1
    return min(score, key=lambda k: (-score[k], k)) if score else None


@lru_cache(1)
def _function_words() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, line in _FUNCTION_WORDS.items():
        for w in line.split():
            out.setdefault(w, []).append(lang)
    return out


def language(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else guess_language(re.findall(r"[^\W\d_]+", t.lower())) for t in texts.to_pylist()], pa.string())

    return run(text)
