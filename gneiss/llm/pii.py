"""Personal data in free text: finding it and replacing it with its type.

All five types are found by bootstrapped contextual extraction. Shapes only say what may be an e-mail
address, phone or identity number, street address or name; each candidate has patterns: what stands to
its left and right, and its form. Seed entities (of a table of persons) and seed words start a graph of
patterns and instances, counted over all texts. A pattern is trusted when most of the different things it
meets are known, and what trusted patterns meet becomes known. After a few rounds the candidates that a
trusted pattern meets are the result, also those seen once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.session import cut_lineage

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = "email", "phone", "id_number", "address", "name"
#: Rounds of the bootstrap.
ROUNDS = 3
#: Log odds from which a word's syllables make it a name.
LIKELY = 1.5
#: A pattern is trusted only if it meets at least this share of all different (pattern, instance) pairs, so at most 1/share are.
PATTERN_SHARE = 2e-5
#: Of what a pattern meets, no single instance is more than this share: what names fill varies, a fixed phrase doesn't.
ONE_INSTANCE = 0.3
#: A form that at least this share of a type's seeds has is trusted from the start.
SEED_FORMS = 0.01
#: A form is trusted when at least this share of the different values that have it is known.
FORM_SHARE = 0.1
#: A seed pattern stays trusted while at least this share of the different instances it meets is known.
SEED_KNOWN = 0.5

# --- shapes ------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?(?:@|＠|[ ]?[(\[]at[)\]][ ]?)[A-Za-z0-9-]+(?:(?:\.|[ ]?[(\[]dot[)\]][ ]?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_WIDE = str.maketrans("０１２３４５６７８９－．（）＋　", "0123456789-.()+ ")
_SPOKEN = str.maketrans("공영일이삼사오육칠팔구", "00123456789")
_SEP = r"[ ]?[-.·–][ ]?|[ ]"
#: Phone numbers on text with plain digits; look-arounds keep parts of longer numbers out.
_PHONE = re.compile(
    rf"""(?<![0-9A-Za-z_*+-])(?<![0-9][.,])(?:
        \+82(?:[ -]?\(?0\)?)?(?:{_SEP})?(?:1[016789]|2|[3-6]\d|70)(?:{_SEP})?\d{{3,4}}(?:{_SEP})?\d{{4}}
      | 0082(?:{_SEP})?(?:1[016789]|2|[3-6]\d|70)(?:{_SEP})?\d{{3,4}}(?:{_SEP})?\d{{4}}
      | \((?:01[016789]|02|0[3-6]\d|070)\)(?:{_SEP})?\d{{3,4}}(?:{_SEP})?\d{{4}}
      | 01[016789](?:(?:{_SEP})\d{{3,4}}(?:{_SEP})\d{{4}}|\d{{7,8}})
      | (?:02|0[3-6]\d|070)(?:(?:{_SEP})\d{{3,4}}(?:{_SEP})\d{{4}}|\d{{7,8}})
      | 1[5-8]\d\d(?:{_SEP})\d{{4}}
      | 1[5-8]\d{{6}}(?=\s*(?:으로|로|번으로)\s*(?:연락|전화))
    )(?![\d*]|[-.]\d)""",
    re.X,
)
_SPOKEN_PHONE = re.compile(r"(?<![가-힣\d])공일[공일육칠팔구][\s.-]{0,2}[공영일이삼사오육칠팔구]{3,4}[\s.-]{0,2}[공영일이삼사오육칠팔구]{4}(?![공영일이삼사오육칠팔구]{2})")
_ID = re.compile(
    r"(?<![0-9A-Za-z_*-])(?:(?P<rrn>\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[ ]?[-–][ ]?|[ ])?[1-8]\d{6})|(?P<licence>\d{2}-\d{2}-\d{6}-\d{2})|(?P<passport>[MSRGD][A-Z0-9]?\d{7,8}))(?![\d*]|-\d)"
)

#: Words that end like a district but aren't one.
_NO_DISTRICT = "다시|역시|혹시|즉시|잠시|몇시|표시|접시|반드시|필요시|당시|임시|수시|일시|또다시|택시|개시|게시|친구|입구|출구|가구|기구|도구|요구|구|시|도|군"
_BIG = r"[가-힣]{1,8}(?:특별자치도|특별자치시|특별시|광역시|도)"
_TOWN = rf"(?!(?:{_NO_DISTRICT})[\s,])[가-힣]{{1,8}}(?:시|군|구)"
_VILLAGE = r"[가-힣]{1,8}\d{0,2}(?:읍|면|동|리|가)"
_ROAD = r"[가-힣]{1,10}(?:\d{1,3}(?:번)?)?(?:대로|로|길)(?:\d{1,3}(?:번)?길)?"
_LOT = r"(?:산[ ]?)?\d{1,4}(?:-\d{1,4})?(?![\d,.]*(?:원|개|번째|일|월|년|회|장|분|시간|인용|%))"
_KO_ADDRESS = re.compile(
    rf"(?<![가-힣])(?:(?:{_BIG},?\s+(?:{_TOWN},?\s+){{0,2}}|(?:{_TOWN},?\s+){{1,3}})(?:{_VILLAGE},?\s+)?{_ROAD}\s*{_LOT}|(?:{_BIG},?\s+(?:{_TOWN},?\s+){{0,2}}|(?:{_TOWN},?\s+){{1,3}})(?:{_VILLAGE}\s+){{1,2}}{_LOT})"
)
#: A road without its district counts after a word for addresses, or before a building.
_KO_ROAD = re.compile(rf"(?:(?<=주소: )|(?<=주소는 )|(?<=배송지: )|(?<=배송지를 )|(?<=배송지는 ))(?:{_ROAD}|{_VILLAGE})\s+{_LOT}|(?<![가-힣])(?!\S*으로\s){_ROAD}\s+{_LOT},?\s+[가-힣]{{2,10}}(?:아파트|빌라|빌딩|타워|오피스텔|맨션|주택)")
_EN_ADDRESS = re.compile(
    r"(?<![\w-])\d{1,5}(?:-\d{1,4})?[ ]+(?:[A-Z][a-z]+(?:[0-9]*beon)?-(?:ro|gil|daero)(?:[ ]\d+(?:beon)?-gil)?|(?:[A-Z][a-z]+[ ]){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b)(?:,[ ]*(?-i:[A-Z])[a-z]+(?:-(?:dong|eup|myeon|gun|gu|si|do))?)*",
    re.IGNORECASE,
)
_JA_ADDRESS = re.compile(r"(?<![一-鿿々])(?:[一-鿿々]{1,4}[都道府県])?(?:[一-鿿々ヶケノ]{1,5}[市区町村郡]){1,3}[一-鿿々ぁ-んァ-ヶー]{1,8}\d{1,3}(?:丁目\d{1,4}番(?:地|\d{1,4}号)?|-\d{1,4}(?:-\d{1,4}|(?![\d-]|[日時分週年月個名人回枚円%]|か月|ヶ月))|番地)")


_HAS_WIDE = re.compile("[０-９－．（）＋　]")
#: Cheap tests that most texts fail, though every match passes them.
_RUN = re.compile(r"\d[\d \-.–·()]{6}")
_PASSPORT_HINT = re.compile(r"[MSRGD][A-Z0-9]?\d{7}")
_KO_HINT = re.compile(r"[로길동리읍면가]\d{0,3}\s*(?:산 ?)?\d")
_EN_HINT = re.compile(r"-(?:ro|gil|daero)|\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd)\b", re.IGNORECASE)
_NUMBER_WORD = re.compile(r"\d[ ]+[A-Za-z]")
_JA_HINT = re.compile(r"[市区町村郡][一-鿿々ぁ-んァ-ヶー]{1,8}\d")
_AT_HINT = re.compile(r"[@＠]|[(\[]at[)\]]", re.IGNORECASE)


def shaped(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of everything with a shape of its own, by position, without overlaps."""
    plain = text.translate(_WIDE) if _HAS_WIDE.search(text) else text  # lengths don't change
    found: list[tuple[int, int, str]] = []
    if _AT_HINT.search(plain):
        found += [(m.start(), m.end(), EMAIL) for m in _EMAIL.finditer(plain)]
    if _RUN.search(plain):
        found += [(m.start(), m.end(), ID_NUMBER) for m in _ID.finditer(plain)]
        found += [(m.start(), m.end(), PHONE) for m in _PHONE.finditer(plain)]
    elif _PASSPORT_HINT.search(plain):
        found += [(m.start(), m.end(), ID_NUMBER) for m in _ID.finditer(plain)]
    if _KO_HINT.search(plain):
        whole = [m.span() for m in _KO_ADDRESS.finditer(plain)]
        found += [(a, b, ADDRESS) for a, b in whole]
        # A road by itself only where no district stands before it: the address starts at the largest one given.
        found += [(m.start(), m.end(), ADDRESS) for m in _KO_ROAD.finditer(plain) if all(m.end() <= a or b <= m.start() for a, b in whole)]
    if _NUMBER_WORD.search(plain) and _EN_HINT.search(plain):
        found += [(m.start(), m.end(), ADDRESS) for m in _EN_ADDRESS.finditer(plain)]
    if _JA_HINT.search(plain):
        found += [(m.start(), m.end(), ADDRESS) for m in _JA_ADDRESS.finditer(plain)]
    if "공일" in plain:
        found += [(m.start(), m.end(), PHONE) for m in _SPOKEN_PHONE.finditer(plain)]
    return without_overlaps(found)


# --- contexts ----------------------------------------------------------------------------------

#: Frequent Korean family names of one syllable; those of the seed table are added.
FAMILY_NAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민류나진지엄채원천방공현함변염여추도소석선설마길연위표명기반라왕금옥육인맹제모탁국은편용예경봉사부가복태목형피두감호제갈"
#: Korean family names of two syllables.
LONG_FAMILY_NAMES = ("남궁", "황보", "제갈", "사공", "선우", "서문", "독고", "동방", "망절", "어금")
#: Titles and endings that follow a person's name. A name of two syllables is a candidate only before one
#: of them or after a word that announces a name, for every other word of two syllables looks the same.
PERSON_ENDINGS = ("님", "씨", "께", "고객", "귀하", "선생", "과장", "대리", "부장", "팀장", "입니다", "이에요", "예요", "이라고", "라고", "드림", "올림")
#: Words of name shape that address or describe somebody without naming them.
NO_NAMES = {"고객님", "상담원", "기사님", "담당자", "선생님", "사장님", "이사님", "배송지", "주문자", "신청인", "수령인", "예금주", "구매자", "판매자", "가족들", "부모님", "어머니", "아버지", "남자친구", "여자친구", "이웃집", "주인공", "관리인", "경비원", "안내문", "구성품", "주문번호", "송장번호", "고양이", "전화번호", "이메일"}
#: Seed patterns of names, written as (word before, rest of the name's word, next word); None is any.
SEED_NAMES = (
    ("이름은", "입니다", None), ("이름은", "이에요", None), ("이름은", "예요", None), ("성함은", "입니다", None), ("성함은", "이에요", None), ("이름", "", None), ("성함", "", None),
    ("주문자는", None, None), ("주문자", "", None), ("예금주는", None, None), ("예금주", "", None), ("수령인은", None, None), ("수령인", None, "님"), ("수령인", "님", None), ("신청인은", None, None), ("신청인", "", None), ("받는사람은", None, None), ("사람은", None, "씨입니다"), ("사람은", None, "씨예요"),
    (None, "", "드림"), (None, "", "올림"), (None, "", "귀하"), (None, "", "과장님이"), (None, "님께서", "문의하신"), (None, "고객님께서", None), (None, "한테", "전화를"), (None, "이름으로", None), (None, "", "이름으로"),
    ("name is", "", None), ("Dear", "", None), ("Regards,", "", None), ("Sincerely,", "", None), ("Mr.", "", None), ("Ms.", "", None), ("Mrs.", "", None),
    ("名前は", None, None), ("お名前は", None, None), ("宛名は", None, None), ("氏名は", None, None), ("受取人は", None, None), ("注文者は", None, None),
)
#: Words that announce the other types, as they stand before the value.
SEED_WORDS = {
    EMAIL: ("이메일", "메일", "이메일은", "메일은", "email", "e-mail", "mail", "メール", "メールは"),
    PHONE: ("전화", "전화번호", "연락처", "연락처는", "휴대폰", "휴대전화", "번호는", "phone", "tel", "call", "mobile", "電話", "電話は"),
    ID_NUMBER: ("주민번호", "주민번호는", "주민등록번호", "주민등록번호는", "여권번호", "여권번호는", "여권", "면허번호", "면허번호는", "운전면허", "통관용으로", "id", "passport", "licence", "license", "身分証番号は", "パスポート番号は"),
    ADDRESS: ("주소", "주소는", "배송지", "배송지는", "배송지를", "address", "ship to", "goes to", "deliver to", "live at", "located at", "住所は", "住所"),
}
#: Words that begin what follows a value, in scripts that glue it to the value.
SEED_AFTER = {ADDRESS: ("に送", "へ送", "に届", "へ届", "に配送", "に住", "にお送り", "へお送り")}
_ANNOUNCED = {kind: {w.lower(): i for i, w in enumerate(words)} for kind, words in SEED_WORDS.items()}
_BEFORE: dict[str, list[int]] = {}
_NEXT: dict[str, list[int]] = {}
_REST: dict[str, list[int]] = {}
for _i, (_b, _r, _n) in enumerate(SEED_NAMES):
    (_BEFORE.setdefault(_b.split(" ")[-1], []) if _b else _NEXT.setdefault(_n, []) if _n else _REST.setdefault(_r, [])).append(_i)
_TWO_WORDS = {b for b, _, _ in SEED_NAMES if b and " " in b}
#: Words before which, or after which, a name of two syllables is a candidate.
_ANNOUNCE_NAMES = {b for b, _, _ in SEED_NAMES if b and " " not in b}

_ENDS = ".!?,;:~…。！？\"'”’"
_DIGIT = re.compile(r"\d[\d\-./,() ]*")
_LETTERS = re.compile(r"[^\W\d_]{2}")
_WORD = r"[A-Z][a-z]{1,20}(?:[-'’][A-Z]?[a-z]+)?"
_LATIN_RUN = re.compile(rf"(?<![\w'’-]){_WORD}(?:[ ](?:{_WORD}|[A-Z]\.))*(?![\w'’-])")
#: Capitalised words that open sentences and labels, and titles, rather than names.
_NO_LATIN = {"The", "My", "Your", "Please", "Can", "How", "What", "When", "Where", "Why", "Who", "Hello", "Hi", "Dear", "Thanks", "Thank", "Regards", "Sincerely", "Order", "Item", "Model", "Type", "Message", "Phone", "Mail", "Call", "Ship", "Passport", "Reply", "We", "It", "Is", "If", "In", "On", "At", "Our", "This", "That", "These", "There", "They", "You", "Opened", "Shipping", "Unfortunately", "Regrettably", "Mr", "Ms", "Mrs", "Puede", "Su", "El", "La", "Sie", "Die", "Der", "Das", "Ihre", "Navy", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"}
_JA_NAME = re.compile(r"(?<=は)([一-鿿々ヶ][一-鿿々ヶノ]{1,3}[ぁ-んァ-ヶー一-鿿々]{1,5}?)(です|でお願い|と申し|様|さん)")
_JA_LEFT = re.compile(r"[一-鿿々お]{1,4}は$")

#: Slots of patterns, the last three bits of their ids: an occurrence has at most one of each (but for seeds).
LEFT, RIGHT, SHORT, FORM, SEED = range(5)


def pattern_id(slot: int, kind: str, text: str) -> int:
    """The number of a pattern: 61 bits of a hash, and its slot."""
    return (xxhash.xxh3_64_intdigest(f"{kind}|{text}") >> 3 << 3 | slot) - (1 << 63)


@lru_cache(maxsize=100_000)
def _pattern(slot: int, kind: str, text: str) -> int:
    return pattern_id(slot, kind, text)


@lru_cache(maxsize=100_000)
def _word(token: str) -> str:
    """A neighbouring word as patterns hold it: digits are one sign, marks at its ends are gone."""
    w = token.strip(_ENDS)
    return _DIGIT.sub("#", w) if w else token[:1]


@lru_cache(maxsize=100_000)
def _tells(word: str) -> bool:
    """Does a neighbouring word say something? The start of a sentence, numbers and codes don't."""
    return "#" not in word and bool(_LETTERS.search(word))


@lru_cache(maxsize=200_000)
def _name_patterns(left: str, rest: str, one: str, two: str) -> tuple[int, ...]:
    """The patterns of a name: the word before with the rest of the name's own word, that rest with the next words."""
    patterns = []
    if _tells(left):
        patterns.append(_pattern(LEFT, NAME, f"{left}|{rest}"))
    if _tells(one):
        patterns.append(_pattern(SHORT, NAME, f"{rest}|{one}"))
        patterns.append(_pattern(RIGHT, NAME, f"{rest}|{one}|{two}"))
    for i in (*_BEFORE.get(left.rsplit(" ", 1)[-1], ()), *_NEXT.get(one, ()), *_REST.get(rest, ())):
        before, own, nxt = SEED_NAMES[i]
        if (before is None or before == left or before not in _TWO_WORDS or left.endswith(before)) and own in (None, rest) and nxt in (None, one):
            patterns.append(_pattern(SEED, NAME, str(i)))
    return tuple(patterns)


class Contexts:
    """Candidates of a text with their patterns. Built once from the family names of the seed table."""

    def __init__(self, family: set[str]):
        self.family = frozenset(family)
        first = "".join(sorted(self.family))
        self.start = re.compile(rf"(?<![가-힣A-Za-z0-9])[{first}](?:[가-힣]+|[ ][가-힣]{{2,}})")

    def __reduce__(self):
        return Contexts, (set(self.family),)

    def candidates(self, text: str) -> list[tuple[int, int, str, str, list[int]]]:
        """(start, end, type, instance, pattern ids) of everything that may be personal data, by its shape."""
        shapes = shaped(text)
        found = [(a, b, kind, *self._shape(text, a, b, kind)) for a, b, kind in shapes]
        beside = {a: f"<{kind}>" for a, _, kind in shapes}
        self._hangul(text, found, beside)
        self._latin(text, found, beside)
        if "は" in text:
            for m in _JA_NAME.finditer(text):
                left = _JA_LEFT.search(text, max(0, m.start() - 5), m.start())
                if left:
                    found.append((m.start(1), m.end(1), NAME, m.group(1), _name_patterns(left.group(), m.group(2), "", "")))
        return found

    def _shape(self, text: str, a: int, b: int, kind: str) -> tuple[str, list[int]]:
        """The value as it is compared, and the patterns of its place and form."""
        value = normalised(text[a:b], kind)
        before, after = text[max(0, a - 40) : a].split(), text[b : b + 40].split()
        left = _word(before[-1]) if before else "^"
        one = _word(after[0]) if after else ""
        two = _word(after[1]) if len(after) > 1 else ""
        patterns = [_pattern(FORM, kind, form(value, kind))]
        word = left.strip("(:：[").lower()
        if (i := _ANNOUNCED[kind].get(word)) is not None or before[1:] and (i := _ANNOUNCED[kind].get(f"{_word(before[-2]).lower()} {word}")) is not None:
            patterns.append(_pattern(SEED, kind, str(i)))
        elif one.startswith(SEED_AFTER.get(kind, ())):
            patterns.append(_pattern(SEED, kind, "after"))
        if _tells(left):
            patterns.append(_pattern(LEFT, kind, left))
        if _tells(one):
            patterns.append(_pattern(SHORT, kind, one))
            patterns.append(_pattern(RIGHT, kind, f"{one}|{two}"))
        return value, patterns

    def _hangul(self, text: str, found: list, beside: dict[int, str]) -> None:
        for m in self.start.finditer(text):
            a, core = m.start(), m.group()
            after = None
            if core[1] == " ":
                if a and not text[a - 1].isspace():
                    continue
                lengths = (4,)  # the space counts
            elif len(core) > 3 and core.startswith(LONG_FAMILY_NAMES):
                lengths = (4, 3)
            elif len(core) > 2:
                lengths = (3, 2) if core[2:].startswith(PERSON_ENDINGS) else (3,)
            else:
                lengths = (2,)
            before = text[max(0, a - 40) : a]
            if before and not before[-1].isspace():  # glued to a mark or to its label
                chunk = before.split()[-1] if before.strip() else before
                before = chunk.rstrip(_OPENING) or chunk
                left = _word(before)
            else:
                words = before.split()
                left = _word(words[-1]).lstrip("(-[“\"'") or "^" if words and words[-1][-1] not in ".!?。！？" else "^"
            for n in lengths:
                name = core[:n].replace(" ", "")
                if name in NO_NAMES or core[:4] in NO_NAMES:
                    continue
                if after is None:
                    end = a + len(core)
                    tail = text[end : end + 40]
                    after = tail.split()
                    glued = after.pop(0) if tail and not tail[0].isspace() and after else ""
                    if beside and (near := beside.get(_BETWEEN.match(text, end).end())):
                        after, glued = [near], ""
                rest = (core[n:] + glued).strip(_ENDS + ")")
                one = _word(after[0]) if after else ""
                if n == 2 and core[1] != " " and not rest.startswith(PERSON_ENDINGS) and not (not rest and one.startswith(PERSON_ENDINGS)) and left not in _ANNOUNCE_NAMES:
                    continue
                patterns = _name_patterns(left, rest, one, _word(after[1]) if len(after) > 1 else "")
                if patterns:
                    found.append((a, a + n, NAME, name, patterns))

    def _latin(self, text: str, found: list, beside: dict[int, str]) -> None:
        for m in _LATIN_RUN.finditer(text):
            words, at, end = m.group().split(" "), m.start(), m.end()
            while words and words[0].rstrip(".") in _NO_LATIN:
                at += len(words.pop(0)) + 1
            while words and words[-1].rstrip(".") in _NO_LATIN:
                end -= len(words.pop()) + 1
            if not 1 <= len(words) <= 4 or any(w.rstrip(".") in _NO_LATIN for w in words):
                continue
            before, after = text[max(0, at - 40) : at].split(), text[end : end + 30].split()
            left = " ".join(before[-2:]) if before else "^"
            if beside and (near := beside.get(_BETWEEN.match(text, end).end())):
                after = [near]
            patterns = _name_patterns(left, "", _word(after[0]) if after else "", _word(after[1]) if len(after) > 1 else "")
            if patterns:
                found.append((at, end, NAME, " ".join(words), patterns))


#: What may stand between a name and a value of another type that follows it; the value's type then is the next word.
_BETWEEN = re.compile(r"[\s/|,;:·(-]*")
_OPENING = "([{<“‘\"'「『【（:：=＝-–—/|,·"
_RANK = {EMAIL: 0, ID_NUMBER: 1, PHONE: 2, ADDRESS: 3, NAME: 4}


def without_overlaps(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping finds the one of the surer type stays, then the longer, then the first."""
    if len(found) < 2:
        return found
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (_RANK[x[2]], x[0] - x[1], x[0])):
        if all(b <= c or d <= a for c, d, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def normalised(value: str, kind: str) -> str:
    """A value as it is compared: phones and numbers by their digits, mail addresses in lower case, addresses without separators."""
    if kind == EMAIL:
        return re.sub(r"\s?[(\[]dot[)\]]\s?", ".", re.sub(r"\s?[(\[]at[)\]]\s?|＠", "@", value, flags=re.IGNORECASE), flags=re.IGNORECASE).lower()
    if kind == PHONE:
        digits = re.sub(r"\D", "", value.translate(_WIDE).translate(_SPOKEN))
        return re.sub(r"^(?:00)?82\D*0?", "0", digits) if digits.startswith(("82", "0082")) else digits
    if kind == ID_NUMBER:
        return re.sub(r"[^0-9A-Za-z]", "", value.translate(_WIDE)).upper()
    return " ".join(value.replace(",", " ").split())


def form(value: str, kind: str) -> str:
    """What values of a type have in common: the class of a phone or identity number, the kinds of an address's parts."""
    if kind == EMAIL:
        return "a@a"
    if kind == PHONE:
        return "mobile" if value.startswith("01") else "service" if value[:1] == "1" else "internet" if value.startswith("070") else "landline"
    if kind == ID_NUMBER:
        return "letters" if value[:1].isalpha() else str(len(value))
    parts = value.split()
    if any("가" <= c <= "힣" for c in value):
        return "road" if re.search(r"[로길]\s*(?:산 ?)?\d", value) else "lot"
    return "latin" if parts and parts[0][:1].isdigit() else "other"


# --- the graph ---------------------------------------------------------------------------------

_CANDIDATE = "field string, start_pos int, end_pos int, pii_type string, instance string, patterns array<bigint>"


def candidates(df: DataFrame, key: str, texts: list[str], contexts: Contexts) -> DataFrame:
    """(key, field, start_pos, end_pos, pii_type, instance, patterns): a row per candidate in any of the texts."""
    shared = df.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.candidates
        for b in batches:
            take, rows = [], []
            for c, field in enumerate(texts):
                for i, text in enumerate(b.column(c + 1).to_pylist()):
                    if text:
                        for x in find(text):
                            take.append(i)
                            rows.append((field, *x))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(v, t) for v, t in zip(cols, kinds)]], names=["k", "field", "start_pos", "end_pos", "pii_type", "instance", "patterns"])

    return df.select(key, *texts).mapInArrow(run, f"k {dict(df.dtypes)[key]}, {_CANDIDATE}")


def pattern_graph(found: DataFrame) -> DataFrame:
    """(pii_type, pattern, slot, instance, n): how often each pattern meets each instance, over all rows."""
    met = found.select("pii_type", F.explode("patterns").alias("pattern"), "instance")
    return met.groupBy("pii_type", "pattern", "instance").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.col("pattern").bitwiseAND(F.lit(7).cast("bigint")).cast("int"))


def bootstrap(found: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, share: float = PATTERN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(trusted, never): trusted patterns (pii_type, pattern), and frequent instances (pii_type, instance) that are none.

    found: as ``candidates`` gives them; seeds: pii_type, instance, form (a pattern id or null). Each round
    scores instances and patterns by each other. An instance is known if it is a seed, if trusted patterns
    meet half of its occurrences, or several different ones a quarter, or, of names, if its syllables are those of known names rather than of
    other words. A context is trusted if most of the different instances it meets, and most of their
    occurrences, are known, and if no single one prevails (what such a place holds varies). A form is
    trusted if seeds have it or a part of what has it is known. Seed patterns stay trusted unless most of
    what they meet stands mostly elsewhere. These are shares, so they stay as a corpus grows or
    is loaded again. Instances met often, and mostly not by trusted patterns, are never personal data.

    Both results stay in tables; learned contexts have at least ``share`` of all pairs each and frequent
    instances ``share`` of all occurrences, which bounds their number; forms and seed patterns are fixed.
    """
    spark = found.sparkSession
    edges = cut_lineage(pattern_graph(found))
    occurrences = cut_lineage(found.groupBy("pii_type", "instance").agg(F.count(F.lit(1)).alias("occurs")))
    pairs, met = edges.count(), occurrences.agg(F.sum("occurs")).first()[0] or 0
    least, often = max(3, int(share * pairs)), max(20, int(share * met))
    per = F.col("slot") <= SHORT
    sizes = edges.groupBy("pii_type", "pattern", "slot").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("total"), F.max("n").alias("largest"))
    eligible = sizes.filter(~per | (F.col("different") >= least) & (F.col("largest") <= F.greatest(F.lit(1), ONE_INSTANCE * F.col("total"))))
    common = cut_lineage(edges.join(eligible.select("pii_type", "pattern", "different", "total"), ["pii_type", "pattern"]))
    seeds = cut_lineage(seeds)
    syllables = occurrences.filter((F.col("pii_type") == NAME) & F.col("instance").rlike("^[가-힣]{3}$")).select("instance", "occurs", F.substring("instance", 2, 1).alias("s2"), F.substring("instance", 3, 1).alias("s3"))
    all_seeds = seeds.groupBy("pii_type").agg(F.count(F.lit(1)).alias("of"))
    seeded = seeds.filter("form is not null").groupBy("pii_type", F.col("form").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(all_seeds), "pii_type").filter(F.col("n") >= SEED_FORMS * F.col("of")).select("pii_type", "pattern")  # at most 1/SEED_FORMS a type
    trusted = edges.filter(F.col("slot") == SEED).select("pii_type", "pattern").distinct().unionByName(seeded).distinct()
    reliable = None
    for turn in range(rounds):
        # A broadcast of bounded size: seeds, forms, and contexts of at least ``share`` of all pairs each.
        mine = common.join(F.broadcast(cut_lineage(trusted)), ["pii_type", "pattern"])
        # Within one slot the occurrences met are counted once each; the best slot says how many are met at least.
        best = lambda of: F.greatest(*[F.sum(F.when(F.col("slot") == s, of).otherwise(0)) for s in (LEFT, RIGHT, SHORT, FORM, SEED)])
        met = mine.groupBy("pii_type", "instance").agg(best(F.col("n")).alias("met"), best(F.lit(1)).alias("ways")).join(occurrences, ["pii_type", "instance"])
        reliable = cut_lineage(met.filter((F.col("met") >= 0.5 * F.col("occurs")) | (F.col("ways") > 1) & (F.col("met") >= 0.25 * F.col("occurs"))).select("pii_type", "instance"))
        known = reliable.unionByName(seeds.select("pii_type", "instance"))
        known = known.unionByName(_name_like(syllables, known).select(F.lit(NAME).alias("pii_type"), "instance")).distinct().withColumn("is_known", F.lit(1))
        scored = common.join(known, ["pii_type", "instance"], "left").groupBy("pii_type", "pattern", "slot").agg(
            F.first("different").alias("different"), F.first("total").alias("total"), F.count("is_known").alias("known"), F.sum(F.when(F.col("is_known").isNotNull(), F.col("n")).otherwise(0)).alias("known_n"),
        )
        context = per & (F.col("known") >= 5) & (F.col("known") >= 0.8 * F.col("different")) & (F.col("known_n") >= 0.8 * F.col("total"))
        shape = (F.col("slot") == FORM) & (F.col("known") >= 5) & (F.col("known") >= FORM_SHARE * F.col("different"))
        seed = (F.col("slot") == SEED) & ((F.col("known") >= SEED_KNOWN * F.col("different")))
        trusted = scored.filter(context | shape | seed).select("pii_type", "pattern").unionByName(seeded).distinct()
    frequent = occurrences.filter((F.col("pii_type") == NAME) & (F.col("occurs") >= often))
    never = frequent.join(reliable, ["pii_type", "instance"], "left_anti").join(seeds, ["pii_type", "instance"], "left_anti").select("pii_type", "instance")
    return cut_lineage(trusted), cut_lineage(never)


def _name_like(syllables: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates of three Hangul syllables whose second and third are like those of known names.

    The odds are a naive Bayes over (place, syllable): known names count once each, other words as often
    as they occur, for names not yet known are rare among them. Its tables have a row per Hangul syllable.
    """
    mine = known.filter(F.col("pii_type") == NAME).select("instance").distinct().withColumn("k", F.lit(1))
    every = syllables.join(mine, "instance", "left").select("instance", "s2", "s3", F.coalesce("k", F.lit(0)).alias("k"), F.when(F.col("k").isNull(), F.col("occurs")).otherwise(0).alias("o"))
    places = every.select(F.explode(F.array(F.struct(F.lit(2).alias("place"), F.col("s2").alias("s")), F.struct(F.lit(3).alias("place"), F.col("s3").alias("s")))).alias("x"), "k", "o")
    counts = places.groupBy("x.place", "x.s").agg(F.sum("k").alias("a"), F.sum("o").alias("b"))
    of = Window.partitionBy("place")  # at most a row per syllable
    odds = F.log((F.col("a") + 0.2) / (F.sum("a").over(of) + 20.0)) - F.log((F.col("b") + 0.2) / (F.sum("b").over(of) + 20.0))
    odds = cut_lineage(counts.select("place", "s", odds.alias("odds")))
    table = lambda n: F.broadcast(odds.filter(F.col("place") == n).select(F.col("s").alias(f"s{n}"), F.col("odds").alias(f"o{n}")))
    return syllables.join(table(2), "s2").join(table(3), "s3").filter(F.col("o2") + F.col("o3") > LIKELY).select("instance")


def family_names(persons: DataFrame, column: str) -> set[str]:
    """The first characters of the seed table's names, besides the fixed ones: at most one per syllable."""
    rows = persons.filter(F.col(column).rlike("^[가-힣]")).select(F.substring(column, 1, 1).alias("f")).distinct().collect()
    return set(FAMILY_NAMES) | {x[0] for x in LONG_FAMILY_NAMES} | {r[0] for r in rows}


def seed_table(persons: DataFrame, name: str | None = None, phone: str | None = None, email: str | None = None, address: str | None = None) -> DataFrame:
    """(pii_type, instance, form): the entities that a table of persons holds, each once, by the columns named."""
    wanted = [(c, kind) for c, kind in ((name, NAME), (phone, PHONE), (email, EMAIL), (address, ADDRESS)) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for c, (_, kind) in enumerate(wanted):
                for value in b.column(c).to_pylist():
                    if not value:
                        continue
                    if kind == NAME:
                        rows.add((kind, "".join(value.split()) if not value.isascii() else value.strip(), None))
                    else:
                        rows.update((k, v := normalised(value[s:e], k), pattern_id(FORM, k, form(v, k))) for s, e, k in shaped(value) if k == kind)
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["pii_type", "instance", "form"])

    return persons.select(*[c for c, _ in wanted]).mapInArrow(run, "pii_type string, instance string, form bigint").distinct()


# --- the operator ------------------------------------------------------------------------------


class Finder:
    """Finds personal data in single texts with the patterns of a bootstrap; shipped to the tasks that redact."""

    def __init__(self, contexts: Contexts, trusted: set[int], never: set[str] = frozenset()):
        self.contexts, self.trusted, self.never = contexts, trusted, never

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        return without_overlaps([(a, b, kind) for a, b, kind, instance, patterns in self.contexts.candidates(text) if not self.trusted.isdisjoint(patterns) and not (kind == NAME and instance in self.never)])

    def redact(self, text: str | None) -> str | None:
        """The text with each find replaced by its type in brackets; null stays null."""
        if not text:
            return text
        out, at = [], 0
        for a, b, kind in self.find(text):
            out += [text[at:a], f"[{kind}]"]
            at = b
        return "".join([*out, text[at:]])


def found_rows(df: DataFrame, key: str, texts: list[str], contexts: Contexts, seeds: DataFrame) -> DataFrame:
    """(key, field, pii_type, start_pos, end_pos): a row per occurrence; repeated rows are merged.

    The texts are read once: candidates and their patterns are kept, scored, and the trusted ones are the
    result. Positions count code points from 0. Null and empty texts have none.
    """
    found = cut_lineage(candidates(df, key, texts, contexts))
    trusted, never = bootstrap(found, seeds)
    # Both are of bounded size, see ``bootstrap``.
    met = found.select("k", "field", "start_pos", "end_pos", "pii_type", "instance", F.explode("patterns").alias("pattern")).join(F.broadcast(trusted), ["pii_type", "pattern"]).join(F.broadcast(never), ["pii_type", "instance"], "left_anti")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.col("pii_type"))
    one = F.struct(rank.alias("rank"), (F.col("start_pos") - F.col("end_pos")).alias("shorter"), "start_pos", "end_pos", "pii_type")
    lists = met.groupBy("k", "field").agg(F.array_sort(F.collect_set(one)).alias("l"))  # the finds of one text
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["start_pos"] < x["end_pos"]) & (x["start_pos"] < y["end_pos"]))
    kept = F.aggregate("l", F.slice("l", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    rows = lists.select(F.col("k").alias(key), "field", F.explode(kept).alias("x"))
    return rows.select(key, "field", "x.pii_type", F.col("x.start_pos").cast("bigint").alias("start_pos"), F.col("x.end_pos").cast("bigint").alias("end_pos"))


def finder(df: DataFrame, key: str, texts: list[str], contexts: Contexts, seeds: DataFrame) -> Finder:
    """A finder with the patterns that a bootstrap over all texts trusts; their number is bounded, see ``bootstrap``."""
    trusted, never = bootstrap(cut_lineage(candidates(df, key, texts, contexts)), seeds)
    return Finder(contexts, {r[0] for r in trusted.select("pattern").collect()}, {r[0] for r in never.select("instance").collect()})


def redacted(df: DataFrame, key: str, texts: list[str], who: Finder) -> DataFrame:
    """(key, texts): every row with its texts redacted."""
    shared = df.sparkSession.sparkContext.broadcast(who)
    schema = ", ".join([f"`{key}` {dict(df.dtypes)[key]}", *[f"`{t}` string" for t in texts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([shared.value.redact(t) for t in c.to_pylist()], pa.string()) for c in b.columns[1:]]], names=[key, *texts])

    return df.select(key, *texts).mapInArrow(run, schema)
