"""Which language a short text is in, from its scripts and, in Latin script, its function words."""

from __future__ import annotations

import re

_SCRIPTS = (
    ("ko", re.compile(r"[가-힣ᄀ-ᇿ㄰-㆏]")),
    ("kana", re.compile(r"[ぁ-ゟァ-ヺー-ヿｦ-ﾟ]")),
    ("han", re.compile(r"[一-鿿㐀-䶿]")),
    ("th", re.compile(r"[ก-๿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("latin", re.compile(r"[A-Za-zÀ-ɏ]")),
)
#: Frequent function words of languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were be has have had not for with on at by from that this it you your we our my i can will would please if or as an do does what how when which been no there here only",
    "de": "der die das und ist sind war wurde wurden nicht ein eine einen einem einer den dem des mit auf für von zu zum zur im am an bei nach aus wir sie ihr ihre ihren ich haben hat kann können wird werden innerhalb oder als auch noch leider bitte",
    "es": "el la los las un una de del y es son fue no en con por para que se su sus lo al le nos puede pueden hay está como más este esta tras desde hasta si su salió plazo",
    "fr": "le la les un une des du de et est sont pas dans avec pour par que se sa son ses au aux nous vous votre vos ne peut sur ce cette être dès chez",
}
_WORD_LANGUAGE: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _WORD_LANGUAGE.setdefault(_w, []).append(_code)
_CODES = re.compile(r"\S*@\S+|\S+\s?[(\[]at[)\]]\s?\S+|https?://\S+|www\.\S+|(?<![A-Za-z0-9])[A-Za-z]{1,4}-?\d[A-Za-z0-9_-]*")
_WORD = re.compile(r"[a-zÀ-ɏ]+")


def language(text: str) -> str:
    """A code (ko, ja, zh, th, hi, ar, ru, en, de, es, fr), ``latin`` if the words don't tell, or empty without letters.

    Addresses and codes are left out. The script with most letters decides; letters of scripts that hold whole words in one sign count
    double against Latin ones, which product names and addresses bring into every language.
    """
    hangul = len(_SCRIPTS[0][1].findall(text))
    if 3 * hangul > len(text):
        return "ko"
    text = _CODES.sub(" ", text)
    counts = {name: len(p.findall(text)) for name, p in _SCRIPTS}
    cjk = counts["kana"] + counts["han"]
    weights = {"ko": 2 * counts["ko"], "ja": 2 * cjk if counts["kana"] else 0, "zh": 0 if counts["kana"] else 2 * cjk, "th": counts["th"], "hi": counts["hi"], "ar": counts["ar"], "ru": counts["ru"], "latin": counts["latin"]}
    best = max(weights, key=lambda k: weights[k])
    if not weights[best]:
        return ""
    if best != "latin":
        return best
    votes: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        for code in (codes := _WORD_LANGUAGE.get(w, ())):
            votes[code] = votes.get(code, 0) + 1 / len(codes)
    if not votes:
        return "latin"
    return max(sorted(votes), key=lambda k: votes[k])


def written_in(text: str, code: str) -> bool:
    """Does the text hold letters of the language's own script? Latin letters, found everywhere, don't tell."""
    script = {"ja": "kana", "zh": "han"}.get(code, code)
    return any(name == script and name != "latin" and p.search(text) for name, p in _SCRIPTS)


def same_language(a: str, b: str) -> bool:
    """Are two codes no evidence of different languages?"""
    latin = {"latin", *FUNCTION_WORDS}
    return not a or not b or a == b or "latin" in (a, b) and a in latin and b in latin or {a, b} == {"ja", "zh"}
