"""Sentence boundaries in any language by a linear-chain model over characters, with Viterbi decoding.

Every character is tagged as opening a sentence or as inside one. Structure settles most of them: a
character can open a sentence only after a break zone (end marks, white space, pictographs) or a closing
bracket or quotation mark, never inside a quotation or bracket, always after a blank line and at a list
item's number. The places that remain form a chain per document that the model decodes.

The model is a conditional random field trained on the corpus itself. What begins texts, paragraphs and
list items can begin a sentence; what never does, though it often follows an end mark or stands in the
middle, cannot. Places before either are the training labels. Beside them, list items and one-sentence
paragraphs are strung together as running text, where the places between them are boundaries and those
within them are not; a share of them loses its end mark, which teaches the boundaries of scripts that
are written without. The rows that the field is fitted on are a bounded sample, drawn evenly over scripts;
the counts behind their labels and decoding cover all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm import crf

#: Documents that training units are taken from, at most, of each of three kinds; drawn evenly over scripts, in hash order of the id.
TRAINING_DOCUMENTS = 1_200
#: Units taken per script, at most.
TRAINING_UNITS = 900
#: Places of one document that are trained on, at most.
TRAINING_PLACES = 40
#: A document longer than this isn't drawn for training (it is decoded like any other).
TRAINING_LENGTH = 40_000

START, INSIDE = "start", "inside"
_END = ".!?…。！？｡।॥"
_PICTURE = "☀-➿\U0001f1e6-\U0001faff️‍"
#: A break zone that can matter by itself: it holds an end mark, a pictograph or a line break. In scripts that leave
#: white space where a sentence ends every zone can; zones of mere spaces beside a quotation or bracket come with it.
_ZONE = re.compile(rf"\s*[\n{_END}{_PICTURE}][\s{_END}{_PICTURE}]*")
_ANY_ZONE = re.compile(rf"[\s{_END}{_PICTURE}]+")
_SPACES = re.compile(r"\s+")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‘": "’", "‹": "›", "《": "》"}
_BRACKETS = "(（[【"
_OPENERS = re.compile("[" + re.escape("".join(_PAIRS)) + '"]')
#: Openers whose closer differs from them, with what counts when they are nested.
_NESTED = {mark: re.compile("[" + re.escape(mark + closers) + "]") for mark, closers in _PAIRS.items() if mark not in "„‘"}
_LIST = re.compile(r"(?:^|(?<=\n))[ \t　]*(?:(\d{1,4})[.)．、](?=[ \t　])|([-*•‣◦–])[ \t]+(?=\S))")
_BLANK = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\n]*\r\n?| ")
_WORD = re.compile(r"[^\s]+")
_LAST_WORD = re.compile(r"[^\s]{2,}$")
_THAI = re.compile(r"[฀-๿຀-໿က-႟ក-៿]")
_DIGITS = re.compile(r"\d+")
#: Letters of the scripts that the draw for training tells apart, besides latin; kana comes before the Han signs it stands with, and Korean in decomposed letters is drawn by itself.
_LETTERS = {"kana": "\u3040-\u30ff", "jamo": "\u1100-\u11ff", "hangul": "\uac00-\ud7a3", "thai": "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff", "deva": "\u0900-\u097f", "cyrillic": "\u0400-\u04ff", "arabic": "\u0600-\u06ff", "han": "\u4e00-\u9fff"}
#: Particles that tie a quotation to the sentence around it.
_QUOTATIVE = re.compile("と|って|라고|이라고|하고|라며|이라며|라는|이라는|라고|하고|이라고")
_NUMBERED = re.compile(r"(?:^|\s)\d{1,4}\.$")


def spans(text: str) -> list[tuple[int, int]]:
    """The outermost quotations and brackets, as [start, end) with their marks.

    One ends at its closing mark (nested ones of its kind are counted) within its paragraph, however long.
    Speech that isn't closed there breaks off with the paragraph; any other mark without its partner is none.
    """
    found, at = [], 0
    while m := _OPENERS.search(text, at):
        i = m.start()
        mark = m.group()
        blank = _BLANK.search(text, i)
        stop = blank.start() if blank else len(text)
        j = _closer(text, i, mark, stop)
        if j < 0 and mark in "“„«「『":
            found.append((i, stop))
            at = stop
        elif j < 0 or mark == "‘" and j == i + 1:
            at = i + 1
        else:
            found.append((i, j + 1))
            at = j + 1
    return found


def _closer(text: str, i: int, mark: str, stop: int) -> int:
    """Where what opens at ``i`` is closed before ``stop``, or -1."""
    closers = '"' if mark == '"' else _PAIRS[mark]
    first = min((p for p in (text.find(c, i + 1, stop) for c in closers) if p >= 0), default=-1)
    if first < 0 or mark not in _NESTED or text.find(mark, i + 1, first) < 0:
        return first
    depth = 1
    for m in _NESTED[mark].finditer(text, i + 1, stop):
        depth += 1 if m.group() == mark else -1
        if not depth:
            return m.start()
    return first


def list_items(text: str) -> dict[int, int]:
    """Start of each list item's number or bullet, and where the number ends.

    A number belongs to a list if the item before or after it, or the first line, continues the count;
    a bullet if another line has the same. A lone number is the wrapped end of a sentence or a date.
    """
    lines = []
    for m in _LIST.finditer(text):
        lines.append((m.start() + len(m.group()) - len(m.group().lstrip(" \t　")), m.end(), m.group(1), m.group(2)))
    out = {}
    for k, (start, end, number, bullet) in enumerate(lines):
        if bullet:
            if sum(x[3] == bullet for x in lines[max(0, k - 1) : k + 2]) > 1:
                out[start] = end
            continue
        n = int(number)
        before = k and lines[k - 1][2] and int(lines[k - 1][2]) == n - 1
        after = k + 1 < len(lines) and lines[k + 1][2] and int(lines[k + 1][2]) == n + 1
        if before or after or n == 1 and not text[:start].strip():
            out[start] = end
    return out


@lru_cache(maxsize=65_536)
def _kind(c: str) -> str:
    """A coarse class of a character."""
    if not c:
        return "edge"
    o = ord(c)
    if c.isdigit():
        return "digit"
    if o < 0x250:
        return "upper" if c.isupper() else "lower" if c.islower() else f"mark{c}"
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF:
        return "hangul"
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0x4E00 <= o <= 0x9FFF:
        return "han"
    if _THAI.match(c):
        return "thai"
    if 0x900 <= o <= 0x97F:
        return "deva"
    if c.isalpha():
        return "upper" if c.isupper() else "lower" if c.islower() else "other"
    return f"mark{c}"


@lru_cache(maxsize=4_096)
def _zone_facts(zone: str) -> tuple[bool, str, bool, str, str, bool]:
    """Of a break zone: white space in it, its end marks, a blank line, how it separates, its mark, pictographs."""
    end_marks = "".join(c for c in zone if c in _END)
    gap = "n" if "\n" in zone else "s" if zone.strip() != zone or zone.isspace() else "0"
    mark = "none" if not end_marks else "dots" if end_marks.startswith(("..", "…")) else end_marks[0] if len(set(end_marks)) == 1 else "mixed"
    return any(c.isspace() for c in zone), end_marks, "\n" in zone and bool(_BLANK.search(zone)), gap, mark, any(c not in _END and not c.isspace() for c in zone)


def _zones(text: str, first: int, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The break zones after ``first`` that can open a sentence, rising; a mark's closing side may be an empty one."""
    if _THAI.search(text):
        zones = [m.span() for m in _ANY_ZONE.finditer(text, first)]
        taken = {a for a, _ in zones}
        zones += [(b, b) for _, b in marks if b not in taken and b < len(text)]
    elif not marks:
        return [m.span() for m in _ZONE.finditer(text, first)]
    else:
        zones = [m.span() for m in _ZONE.finditer(text, first)]
        taken, stops = {a for a, _ in zones}, {b for _, b in zones}
        for start, end in marks:
            if end not in taken and end < len(text):
                m = _SPACES.match(text, end)
                zones.append((end, m.end() if m else end))
                taken.add(end)
                stops.add(zones[-1][1])
            if start not in stops and start > first and text[start - 1].isspace():
                a = len(text[:start].rstrip())
                if a not in taken:
                    zones.append((a, start))
                    taken.add(a)
    zones.sort()
    return zones


def places(text: str, with_features: bool = True) -> tuple[int | None, list[int], list[tuple]]:
    """(first start, sure starts, open places): where sentences of ``text`` may start.

    Of a place left open come its position and what is seen around it (nothing without ``with_features``).
    The first start is None for a text without any character but white space.
    """
    stripped = len(text) - len(text.lstrip())
    if stripped == len(text):
        return None, [], []
    marks = spans(text)
    begins = [a for a, _ in marks]
    ends = {b: a for a, b in marks}
    starts_at = dict(marks)
    items = list_items(text)
    after_number = set(items.values())
    sure: list[int] = []
    open_: list[tuple] = []
    n = len(text)
    for a, b in _zones(text, stripped, marks):
        if b >= n or b <= stripped:
            continue
        if begins:
            k = bisect_right(begins, a) - 1
            if k >= 0 and marks[k][0] < a < marks[k][1]:
                continue  # inside a quotation or bracket
        zone = text[a:b]
        white, end_marks, blank, _, _, _ = _zone_facts(zone)
        if blank or b in items:
            sure.append(b)
            continue
        if after_number and any(p in after_number for p in range(a, b + 1)) and any(s <= a and e >= a for s, e in items.items() if e in range(a, b + 1)):
            continue  # between a list item's number and its text
        right = text[b]
        if right.isdigit() and white and _NUMBERED.search(text, max(0, a - 6), a + 1):
            continue  # a date or a numbering in several parts
        if a in ends and not zone and _QUOTATIVE.match(text, b):
            continue
        closed = ends.get(a)
        if right in ",;:)]}，；：、）」』”’»%":
            continue
        if closed is not None and end_marks and text[closed] in _BRACKETS:
            closed = None if not _own_sentence(text, closed, a, text[closed + 1 : a - 1].rstrip(), stripped, right) else closed
        if b in starts_at and text[b] in _BRACKETS and (end_marks or a == b or "\n" in zone) and _own_sentence(text, b, starts_at[b], text[b + 1 : starts_at[b] - 1].rstrip(), stripped, "", end_marks):
            sure.append(b)
            continue
        if end_marks:
            wide = any(c in "。！？｡।॥…" for c in end_marks)
            if not white and not wide and not _unspaced(text, a, b):
                continue
            if not white and _THAI.match(right):
                continue  # Thai leaves white space where a sentence ends
        elif closed is not None:
            if not white and _THAI.match(right):
                continue
            if text[closed] not in _BRACKETS and _opens(text, closed, stripped):
                continue  # speech that a sentence begins with: the sentence says who spoke
            inner = text[closed + 1 : a - 1].rstrip()
            if inner and (white or not right.isascii()) and _own_sentence(text, closed, a, inner, stripped, right):
                sure.append(b)
                continue
            if not inner or inner[-1] not in _END and not (text[closed] in _BRACKETS and white and _THAI.search(inner)):
                if not (white and (_THAI.match(right) or _THAI.search(inner))):
                    continue
        elif b in starts_at and text[b] in _BRACKETS:
            inner = text[b + 1 : starts_at[b] - 1].rstrip()
            if not (white and inner and (inner[-1] in _END or _THAI.search(inner))):
                continue
        elif not (white and (_THAI.match(right) or _THAI.match(text[a - 1 : a]) or b in starts_at and _THAI.search(text, max(0, a - 40), a))):
            continue
        open_.append((b, _seen(text, a, b, closed, starts_at.get(b)) if with_features else ()))
    return stripped, sure, open_


def _opens(text: str, at: int, first: int) -> bool:
    """Does a quotation at ``at`` stand where a sentence begins?"""
    before = text[:at].rstrip(_PICTURE + " \n\t")
    return at == first or before[-1:] in (*_END, *"”」』»)）") or bool(_BLANK.search(text, len(before), at))


def _unspaced(text: str, a: int, b: int) -> bool:
    """May the mark in text[a:b], without white space after it, end a sentence? Not in numbers, addresses
    and abbreviations: both sides must be plain words, the right one beginning like a sentence."""
    right = _kind(text[b])
    if right in ("hangul", "deva", "han", "kana"):
        return text[a - 1 : a].isalpha()
    token = _WORD.match(text, b)
    before = _LAST_WORD.search(text, max(0, a - 40), a)
    return right == "upper" and bool(before) and before.group().isalpha() and before.group()[1:].islower() and bool(token) and re.sub(rf"[{_END},;:]+$", "", token.group()).isalpha() and token.group()[1:2].islower()


def _own_sentence(text: str, opened: int, end: int, inner: str, first: int, right: str, marks_before: str | None = None) -> bool:
    """Does what stands in text[opened:end] end a sentence? A bracketed one that began after an end, or
    speech after a colon that the sentence doesn't go on from."""
    ended = inner[-1:] in tuple(_END) or bool(_THAI.search(inner)) and len(inner) > 7
    if not ended:
        return False
    before = text[:opened].rstrip()
    if text[opened] in _BRACKETS:
        before = before.rstrip(_PICTURE + " ")
        return opened == first or bool(marks_before) or before[-1:] in (*_END, *"”」』»\")）")
    return before[-1:] in (":", "：") and not (right.islower() and right.isascii())


_JAMO = re.compile("[\u1100-\u11ff]")


def _composed(text: str, most: int = 24) -> str:
    """Korean in decomposed letters as syllables, so that it shows the same features; at most ``most`` characters from the start."""
    return unicodedata.normalize("NFC", text)[:most]


def _seen(text: str, a: int, b: int, closed: int | None, opened: int | None) -> tuple[tuple, tuple, tuple, tuple]:
    """What is seen around the place between text[:a] and text[b:], in four parts: the form of the place, what
    stands left, what stands right, and both."""
    _, _, _, gap, mark, pictured = _zone_facts(text[a:b])
    left, right = text[max(0, a - 24) : a], text[b : b + 24]
    if _JAMO.search(left):
        left = unicodedata.normalize("NFC", text[max(0, a - 60) : a])[-24:]
    if _JAMO.search(right):
        right = _composed(text[b : b + 60])
    left, right = _DIGITS.sub("9", left.lower()), _DIGITS.sub("9", right.lower())
    words, rwords = left.split(), right.split()
    lw = words[-1] if words else ""
    rw = rwords[0] if rwords else ""
    kl, kr = _kind(text[a - 1 : a]), _kind(text[b : b + 1])
    if opened is not None:
        kr = "bracket" if text[b] in _BRACKETS else "quote"
    tail = ""
    if closed is not None:
        tail = "bracket" if text[closed] in _BRACKETS else "quote"
        outside = text[:closed].rstrip()
        inner = text[max(closed + 1, a - 3) : a - 1].rstrip()
        tail += f"{_kind(outside[-1:]) if outside[-1:] not in tuple(_END) else 'end'}{'.' if inner[-1:] in tuple(_END) else ''}"
    return (mark, gap, kl, kr, tail, pictured), (lw, words[-2] if len(words) > 1 else "", left[-4:], mark, kr), (rw, rwords[1] if len(rwords) > 1 else "", right[:6], mark), (lw, rw, left[-2:], right[:2], rw[:3], tail)


def _form_features(mark, gap, kl, kr, tail, pictured) -> list[str]:
    return ["bias", f"shape={mark}|{gap}|{kl}|{kr}", f"mg={mark}{gap}", f"mr={mark}{kr}", f"tail={tail}", f"tailr={tail}{kr}", f"kk={kl}{kr}", f"pic={pictured}{mark}"]


def _left_features(lw, before, end, mark, kr) -> list[str]:
    return [f"lw={lw}", f"lwm={lw}{mark}", f"lwr={lw}{kr}", f"blw={before} {lw}{mark}", f"short={len(lw) <= 1}{mark}{kr}", f"dotted={'.' in lw}{mark}{kr}", *(f"l{n}={end[-n:]}{mark}" for n in (1, 2, 3, 4))]


def _right_features(rw, rw2, begin, mark) -> list[str]:
    return [f"rw={rw}", f"rww={rw} {rw2}", f"mrw={mark}{rw}", *(f"r{n}={begin[:n]}" for n in (1, 2, 3, 4, 6)), f"mr2={mark}{begin[:2]}", f"mr3={mark}{begin[:3]}"]


def _cross_features(lw, rw, end, begin, rw3, tail) -> list[str]:
    return [f"lrw={lw} {rw}", f"lr={end}{begin}", f"tailw={tail}{rw3}"]


_PARTS = (_form_features, _left_features, _right_features, _cross_features)


def features_of(seen: tuple) -> list[str]:
    """The features of a place, from what is seen around it."""
    return [f for part, x in zip(_PARTS, seen) for f in part(*x)]


class Decoder:
    """Scores places with a trained model. With two tags the difference of their scores is enough; that of a
    part of what is seen is remembered, for words and their neighbours recur."""

    #: Parts remembered before they are forgotten; this bounds memory and changes no result.
    REMEMBERED = 100_000

    def __init__(self, model: crf.ChainCRF):
        self.model = model
        start, inside = model.labels.index(START), model.labels.index(INSIDE)
        self.start, self.inside = start, inside
        self.weight = {f: float(model.weights[i, start] - model.weights[i, inside]) for f, i in model.vocabulary.items()}
        self.known: tuple[dict, ...] = tuple({} for _ in _PARTS)

    def __reduce__(self):
        return Decoder, (self.model,)

    def score(self, seen: tuple) -> float:
        total = 0.0
        for known, part, x in zip(self.known, _PARTS, seen):
            s = known.get(x)
            if s is None:
                if len(known) >= self.REMEMBERED:
                    known.clear()
                get = self.weight.get
                s = known[x] = sum(get(f, 0.0) for f in part(*x))
            total += s
        return total

    def tags(self, sequences: list[list[tuple]]) -> np.ndarray:
        """For all places of all sequences, one after the other: does a sentence start there?"""
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        scores = np.zeros((int(lengths.sum()), 2))
        scores[:, self.start] = np.fromiter((self.score(x) for q in sequences for x in q), dtype=np.float64, count=len(scores))
        return self.model.viterbi(scores, lengths) == self.start if len(scores) else np.zeros(0, dtype=bool)


# --- training ----------------------------------------------------------------------------------


_SCRIPTS = (("hangul", re.compile("[가-힣ᄀ-ᇿ]")), ("han", re.compile("[一-鿿]")), ("thai", _THAI), ("deva", re.compile("[ऀ-ॿ]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("arabic", re.compile("[؀-ۿ]")))
_OF_KIND = {name: (name, p) for name, p in _SCRIPTS}
_KANA = re.compile("[\u3040-\u30ff]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")


def _script(text: str) -> str:
    """Kana if there is any, else the script of most letters, latin counting half."""
    if text.isascii():
        return "latin"
    if _KANA.search(text):
        return "kana"
    likely = _OF_KIND.get(_kind(text[len(text) // 2]))
    if likely and len(likely[1].findall(text)) * 2 > len(text):
        return likely[0]  # more than half of all characters: no other can have more letters
    counts = [(len(p.findall(text)), name) for name, p in _SCRIPTS]
    most, name = max(counts, key=lambda x: x[0])
    return name if most * 2 > len(_LATIN.findall(text)) else "latin"


def sure_units(text: str) -> list[str]:
    """Stretches of a document that are one sentence for sure: list items, and paragraphs whose only
    end mark (outside quotations and brackets) is their last character."""
    units = []
    items = list_items(text)
    for start, end in items.items():
        stop = text.find("\n", end)
        line = text[end : len(text) if stop < 0 else stop].strip()
        if len(line) > 8:
            units.append(line)
    if not items:
        for part in _BLANK.split(text):
            part = part.strip()
            if not 12 < len(part) < 200 or "\n" in part:
                continue
            outside = part
            for a, b in reversed(spans(part)):
                outside = outside[:a] + "x" + outside[b:]
            tail = spans(part)[-1:]
            quoted = bool(tail) and tail[0][1] == len(part) and part[-2:-1] in tuple(_END)
            if (outside[-1:] in tuple(_END) or quoted) and not re.search(rf"[{_END}]", outside.rstrip(_END)) or part[-1] in ")）" and spans(part)[-1:] == [(0, len(part))]:
                units.append(part)
    return units


def _strung(units: list[str], seed: int) -> tuple[str, set[int]]:
    """Units as running text, and the positions at which they start.

    How two units are joined, and whether an end mark is dropped, is drawn by hash. Marks are dropped
    only before a line break or in scripts that leave white space where a sentence ends.
    """
    text, starts = "", set()
    for i, u in enumerate(units):
        h = zlib.crc32(f"{seed}:{i}:{u}".encode())
        script = _script(u)
        glue = ("", "", "", " ", "\n")[h % 5] if script in ("kana", "han") and u[-1:] in tuple(_END + "」』”）") else (" ", " ", " ", "  ", "\n")[h % 5]
        body = u
        if script == "thai" and h % 3 == 0:
            body = u.rstrip(_END)
        if (h >> 8) % 9 == 0 and body[-1:] in tuple(_END):
            body = body.rstrip(_END) + body[len(body.rstrip(_END)) :][:1] * 2 if (h >> 12) % 2 else body + " 🙂"
        starts.add(len(text))
        text += body + glue
    return text.rstrip(), starts


#: Plain sentences that the training always sees, so that the smallest corpus has a model.
SEED_SENTENCES = (
    ("The shop opens at 9 a.m. on Monday.", "Mr. Smith lives in the old house.", "Did you see Dr. Brown?", "It costs 4.50 now!", "She works for Green Ltd. and likes it.", "The cat... well, it ran away."),
    ("가게는 오전 9시에 문을 엽니다.", "김 선생님은 어제 돌아왔다.", "지금 몇 시예요?", "그 책은... 글쎄, 찾지 못했다.", "정말 고마워요!"),
    ("店は午前9時に開きます。", "田中さんは昨日帰った。", "今何時ですか？", "その本は……見つからなかった。"),
    ("商店上午9点开门。", "王老师昨天回来了。", "现在几点？", "那本书……谁也没找到。"),
    ("Der Laden öffnet um 9 Uhr.", "Hr. Schmidt wohnt z. B. in Bonn.", "Haben Sie Dr. Braun gesehen?", "Das kostet jetzt 4,50!"),
    ("La tienda abre a las 9 a. m. del lunes.", "El Sr. García vive en la casa vieja.", "¿Ha visto al Dr. Ruiz?", "¡Ahora cuesta 4,50!"),
    ("दुकान सुबह 9 बजे खुलती है।", "डॉ. शर्मा कल लौटे।", "अभी कितने बजे हैं?", "बहुत धन्यवाद!"),
    ("ร้านเปิดเวลา 9 น.ของทุกวัน", "นายสมชายกลับมาเมื่อวานนี้", "ตอนนี้กี่โมงแล้ว", "เธออ่านหนังสือ 3 เล่มเมื่อวันจันทร์"),
)


def _word_key(word: str) -> str:
    """``_key`` of a word in the middle, where a number counts without what follows it."""
    kind = _kind(word[0])
    if kind == "hangul" and _JAMO.search(word):
        word = _composed(word)
    return _DIGITS.sub("9", word[:6] if kind == "thai" else word[:3] if kind in ("han", "kana") else word[:24])


def _key(text: str, at: int) -> str:
    """What a sentence starting at ``at`` would begin with: a word, or some characters in scripts without spaces."""
    kind = _kind(text[at])
    if kind == "thai":
        begin = text[at : at + 6]
    elif kind in ("han", "kana"):
        begin = text[at : at + 3]
    else:
        m = _WORD.match(text, at)
        begin = m.group()[:24] if m else ""
        if kind == "hangul" and _JAMO.search(begin):
            begin = _composed(m.group())
        if begin.isdigit() and (after := _WORD.search(text, m.end(), m.end() + 30)):
            begin += " " + after.group()
    return _DIGITS.sub("9", begin)


#: A word after a single white space that no end mark precedes.
_MIDDLE = re.compile(r"(?<=[^\s.!?…。！？｡।])[^\S\n](\S+)")
_NO_WORD_END = frozenset(".!?…。！？｡।")


class StartCounts:
    """How often what stands at a place also opens texts, paragraphs and list items; of ``wanted`` keys, or of all."""

    def __init__(self, documents: list[str], wanted: set[str] | None = None):
        self.opens: dict[str, int] = {}
        self.open_places: dict[str, int] = {}
        self.middle: dict[str, int] = {}
        self.wanted = wanted
        self.words: dict[str, Counter] = {}  # words in the middle, not yet taken over
        for text in documents:
            self.add(text)
        self.flush()

    def add(self, text: str) -> None:
        first, sure, open_ = places(text, with_features=False)
        if first is None:
            return
        items = list_items(text)
        begins = set()
        for p in (first, *sure):
            p = items.get(p, p)
            while p < len(text) and text[p].isspace():
                p += 1
            if p < len(text):
                begins.add(p)
        script = _script(text)
        for p in begins:
            self._add(self.opens, f"{script}:{_key(text, p)}")
        at_open = {x[0] for x in open_}
        for p in at_open:
            self._add(self.open_places, f"{script}:{_key(text, p)}")
        # Words are counted as they come; what was counted at a begin or an open place is taken back.
        words = self.words.get(script)
        if words is None:
            words = self.words[script] = Counter()
        words.update(_MIDDLE.findall(text))
        for p in begins | at_open:
            if p > 1 and text[p - 1] != "\n" and text[p - 1].isspace() and text[p - 2] not in _NO_WORD_END and not text[p - 2].isspace():
                self._add(self.middle, f"{script}:{_word_key(_WORD.match(text, p).group())}", -1)
        if len(words) > 200_000:
            self.flush()

    def flush(self) -> None:
        """Take the counted words over into the counts of keys."""
        for script, words in self.words.items():
            for word, n in words.items():
                self._add(self.middle, f"{script}:{_word_key(word)}", n)
        self.words = {}

    def _add(self, to: dict[str, int], key: str, n: int = 1) -> None:
        if self.wanted is None or key in self.wanted:
            to[key] = to.get(key, 0) + n

    def verdict(self, script: str, text: str, at: int) -> str | None:
        """START, INSIDE, or None where the counts don't tell."""
        k = script + ":" + _key(text, at)
        opens, places_, middle = self.opens.get(k, 0), self.open_places.get(k, 0), self.middle.get(k, 0)
        if opens >= 2 and opens >= 0.02 * (opens + places_) and opens >= 0.2 * (opens + middle):
            return START
        if opens <= 0.001 * (middle + places_) and (middle >= 2 or places_ >= 12):  # stray starts don't grow into a sign
            return INSIDE
        return None


def asked_keys(documents: list[str]) -> set[str]:
    """The keys whose counts label the training places: at most ``TRAINING_PLACES`` a document."""
    return {f"{script}:{_key(text, at)}" for text in documents for script in [_script(text)] for at, _ in places(text, with_features=False)[2][:TRAINING_PLACES]}


def corpus_counts(df: DataFrame, text: str, wanted: set[str]) -> StartCounts:
    """The counts of the wanted keys over all rows, added up within each task before the shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = StartCounts([], shared.value)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    mine.add(t)
        mine.flush()
        rows = [(kind, k, n) for kind in ("opens", "open_places", "middle") for k, n in getattr(mine, kind).items()]
        kinds, keys, ns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], names=["kind", "key", "n"])

    counts = StartCounts([], wanted)
    for r in df.select(text).mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
        getattr(counts, r["kind"])[r["key"]] = r["n"]
    return counts


def train(documents: list[str], counts: StartCounts | None = None) -> crf.ChainCRF:
    """The model from a sample of documents, labelled by the counts (by default those of the sample itself);
    the same documents and counts give the same model."""
    by_script: dict[str, list[tuple[int, str]]] = {}
    for text in documents:
        for u in dict.fromkeys(sure_units(text)):
            by_script.setdefault(_script(u), []).append((zlib.crc32(u.encode()), u))
    groups: list[list[str]] = [list(s) * 2 for s in SEED_SENTENCES]
    for script in sorted(by_script):
        drawn = [u for _, u in sorted(set(by_script[script]))[:TRAINING_UNITS]]
        groups += [drawn[i : i + 12] for i in range(0, len(drawn), 12)]
    features, gold, lengths = [], [], []
    for n, group in enumerate(groups):
        for seed in (n, n + 100_003):
            text, starts = _strung(group if seed == n else group[::-1], seed)
            _, _, open_ = places(text)
            for at, seen in open_:
                features.append(features_of(seen))
                gold.append(START if at in starts else INSIDE)
            lengths.append(len(open_))
    counts = counts or StartCounts(documents)
    for text in documents:
        _, _, open_ = places(text)
        script, run = _script(text), 0
        for at, seen in open_[:TRAINING_PLACES]:
            label = counts.verdict(script, text, at)
            if label is None:
                lengths.append(run)
                run = 0
                continue
            features.append(features_of(seen))
            gold.append(label)
            run += 1
        lengths.append(run)
    return crf.fit([INSIDE, START], features, gold, lengths, least=2, penalty=3e-6, rounds=60)


# --- decoding ----------------------------------------------------------------------------------


def starts_of(model: crf.ChainCRF | Decoder, texts: list[str | None]) -> list[list[int]]:
    """The positions at which each text's sentences start, rising; none for null, empty and blank texts."""
    decoder = model if isinstance(model, Decoder) else Decoder(model)
    found = [places(text) if text else (None, [], []) for text in texts]
    starts = iter(decoder.tags([[x[1] for x in open_] for _, _, open_ in found]).tolist())
    out = []
    for first, sure, open_ in found:
        mine = [x[0] for x in open_ if next(starts)]
        out.append(sorted({first, *sure, *mine}) if first is not None else [])
    return out


def _script_column(t: Column) -> Column:
    """A script for the draw: the first of the list that the text has a letter of, or latin."""
    found = [F.when(t.rlike(f"[{letters}]"), F.lit(name)) for name, letters in _LETTERS.items()]
    return F.when(F.octet_length(t) == F.length(t), F.lit("latin")).otherwise(F.coalesce(*found, F.lit("latin")))


def training_sample(df: DataFrame, key: str, text: str, most: int = TRAINING_DOCUMENTS) -> list[str]:
    """Texts to train on: those with list items, with paragraphs and with neither, ``most`` of each at most.

    Of each kind the scripts take turns, so a rare one is drawn whole before a frequent one fills the rest.
    """
    t = F.col(text)
    short = df.filter(t.isNotNull() & (F.length(t) <= TRAINING_LENGTH)).select(F.col(key).alias("k"), t.alias("t"))
    listed = F.col("t").contains("1") & F.col("t").contains("2") & F.col("t").rlike(r"(?m)^\s*1[.)]\s") & F.col("t").rlike(r"(?m)^\s*2[.)]\s")
    kind = F.when(listed, 0).when(F.col("t").contains("\n\n"), 1).otherwise(2)
    keyed = short.select("k", "t", kind.alias("kind"), _script_column(F.col("t")).alias("script"), F.xxhash64("k", F.lit(29)).alias("h"))
    turn = F.row_number().over(Window.partitionBy("kind", "script").orderBy("h", "k", "t"))
    drawn = keyed.withColumn("turn", turn).filter(F.col("turn") <= most)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("turn", "script"))
    rows = drawn.withColumn("place", place).filter(F.col("place") <= most).select("kind", "place", "t").collect()
    return [r["t"] for r in sorted(rows, key=lambda r: (r["kind"], r["place"]))]


def sentence_starts(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """(key, start_pos): a row per sentence; with ``with_text`` also sentence_no, end_pos and sentence.

    Positions count code points. The end is that of the last character that isn't white space. Null,
    empty and blank texts have no rows.
    """
    kind = dict(df.dtypes)[key]
    drawn = training_sample(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(Decoder(train(drawn, corpus_counts(df, text, asked_keys(drawn)))))
    schema = f"`{key}` {kind}, start_pos bigint" + (", sentence_no int, end_pos bigint, sentence string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                texts = b.column(1).to_pylist()
                found = starts_of(shared.value, texts)
                take = pa.array([i for i, s in enumerate(found) for _ in s], pa.int64())
                cols = [b.column(0).take(take), pa.array([p for s in found for p in s], pa.int64())]
                if with_text:
                    parts = [(n, t[p:q].rstrip(), p) for t, s in zip(texts, found) for n, (p, q) in enumerate(zip(s, [*s[1:], len(t or "")]))]
                    cols += [pa.array([n for n, _, _ in parts], pa.int32()), pa.array([p + len(x) for _, x, p in parts], pa.int64()), pa.array([x for _, x, _ in parts], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "start_pos", *(["sentence_no", "end_pos", "sentence"] if with_text else [])])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)
