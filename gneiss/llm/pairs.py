"""Defective question-answer pairs.

The clauses of an answer are tagged by a conditional random field as answer, refusal, echo (of the
question), foreign (another language than the question), unfinished or courtesy; the shares of the
tags decide on the pair's defect.

The field is trained on a bounded sample of the pairs themselves. Clauses get the label that sure
signs give them: text contained in the question, another language, set phrases of refusals. For
unfinished clauses the sample's own finished ones are broken off at a place drawn by hash, so the field
learns what the ends of finished clauses look like, with and without their full stop.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.llm import crf
from gneiss.llm.language import language, same_language, written_in

#: Pairs that the field is trained on, at most, per script of the answer (Korean, Han and kana, Latin,
#: others); drawn in hash order of the key.
TRAINING_PAIRS = 700
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, COURTESY = "answer", "refusal", "echo", "foreign", "unfinished", "courtesy"
TAGS = [ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, COURTESY]
EMPTY, TRUNCATED, COPY, OTHER_LANGUAGE = "empty", "truncated", "copy", "other_language"

#: What stands for "no answer" once everything but letters and digits is gone.
PLACEHOLDERS = {"", "null", "none", "nil", "nan", "na", "nothing", "empty", "undefined", "blank", "tbd", "todo", "없음", "미정", "무응답", "답변없음", "내용없음", "해당없음", "빈칸", "なし", "無し", "未定", "空", "回答なし", "无", "無", "暂无", "noanswer", "notapplicable", "keine", "ninguna", "ninguno"}
#: Set phrases of declining to answer, the seeds from which the field learns.
REFUSALS = re.compile(
    r"도와\s*드리기\s*(어렵|힘들)|도와\s*드릴\s*수\s*(가\s*)?없(?!었던)|안내해?\s*드릴\s*수\s*(가\s*)?없(?!었던)|답변(을|은)?\s*(드릴|제공할|할)\s*수\s*(가\s*)?없(?!었던)|답(변)?할\s*(권한|수)이?\s*없(?!었던)|답변(이|을)?\s*(드리기\s*)?(어렵|곤란|불가)|말씀드릴\s*수\s*(가\s*)?없(?!었던)"
    r"|(대답|답변|답|응답|언급|말씀|안내|상담|응대)(을|를|은|는)?\s*(해|하|드리|드려|도와드리)?지\s*(않겠|못\s*(합니다|해|하는|할))|(대답|답변|응답|언급|상담)(을|를|은|는)?\s*(삼가|자제|사양|거절|거부)|(범위|권한|소관|업무)(를|을|에서)?\s*(벗어나|벗어납|벗어난|밖입|밖이라|밖의|아닙|아니라)"
    r"|\b(unable|not able|cannot|can't|can not|not possible|must decline|have to decline|not permitted|not allowed)\b[^.]{0,20}\b(assist|help|answer|comment|provide|discuss|respond|information)|\bdecline to (assist|help|answer|comment)|for me to (answer|comment|assist|help|provide)|\b(will not|won['’]t) (be able to )?(answer|comment|discuss|respond|assist|help)|\b(outside|beyond) (the scope of )?(what (I|we) can|my (scope|role|authority)|our (scope|role|authority))|\brefrain from (answering|commenting)"
    r"|(お答え|回答|ご案内|対応|お手伝い|お応え)(は|を|も)?(いた|致|し|でき|差し)?[^。]{0,8}(かねます|できません|控え|出来ません)|お役に立てません|(対応|回答|案内)(できる|可能な)?範囲(を超え|外)|(回答|お答え)(は|を)?(いた|致)?しません"
    r"|无法(回答|提供|协助|回复|处理)|無法(回答|提供)|不便(回答|透露)|恕[^。]{0,4}(无法|不能)|(不予|不会|拒绝)(回答|回复)|超出[^。]{0,12}范围|(kann|können|darf) [^.]{0,40}nicht (beantworten|helfen|weiterhelfen)|no (puedo|podemos) (responder|ayudar|ofrecer|proporcionar)",
    re.IGNORECASE,
)
#: Set phrases that neither answer nor decline.
COURTESIES = re.compile(
    r"^\W*(감사합니다|고맙습니다|죄송합니다|안녕하세요|좋은 하루|이용해 주셔서|문의 주셔서|불편을 드려 죄송합니다|양해|이해해 주셔서|다른 질문|더 궁금하신|답변이 늦어|thank|thanks|sorry|hello|hi\b|dear\b|best regards|please ask something|have a nice|ありがとう|申し訳|恐れ入り|ご了承|お問い合わせありがとう|谢谢|感谢|敬请|抱歉)",
    re.IGNORECASE,
)
_CLAUSE = re.compile(r"[^.!?。！？…\n]*(?:[.!?。！？…]+(?:[\"'”’」』)\]]*)(?:(?=\s)|(?<=[。！？」』])|$)|[.!?…]+(?=\S)|\n|$)")
_TERMINAL = re.compile(r"(?:[:;]-?[()D]|\^\^|[\s\"'”’」』)\]*~_\u200d\ufe0f\u2600-\u27bf\U0001f300-\U0001faff])+$")
_NO_LETTERS = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d[\d,.]*")
_WORDS = re.compile(r"\w+")


def squeeze(text: str) -> str:
    return _NO_LETTERS.sub("", text.lower())


def clauses(text: str) -> list[str]:
    """Clauses end at a terminal mark followed by white space (in scripts without spaces, at the mark) or at a line's end."""
    out, held = [], ""
    for m in _CLAUSE.finditer(text):
        held += m.group()
        end = m.end()
        inside = end < len(text) and not text[end - 1].isspace() and not text[end].isspace() and text[end - 1] in ".!?…"
        if inside:  # a decimal, date or address
            continue
        if _WORDS.search(held):
            out.append(held.strip())
        elif out and held.strip():
            out[-1] += held.rstrip()
        held = ""
    return out


def masked(clause: str) -> str:
    return _DIGITS.sub("9", clause)


@lru_cache(maxsize=100_000)
def _own(clause: str) -> tuple[tuple[str, ...], str]:
    """What a (masked) clause shows by itself, and its language."""
    bare = _TERMINAL.sub("", clause.lower())
    mark = _mark(bare)
    body = bare.rstrip(".!?。！？…,;:、，・-~ ")
    words = _WORDS.findall(body)
    fs = [f"w={w}" for w in dict.fromkeys(words)]
    fs += [f"ww={a} {b}" for a, b in zip(words, words[1:])]
    fs += [f"mark={mark or 'none'}", f"e1={body[-1:]}", f"e2={body[-2:]}", f"e3={body[-3:]}", f"e5={body[-5:]}", f"lw={words[-1] if words else ''}", f"lww={' '.join(words[-2:])}", "bias"]
    if len(body) > 2 and body.endswith("니다") and (ord(body[-3]) - 0xAC00) % 28 == 17 or re.search(r"(세요|[어아해]요|[까네]요|십시오|니까|[이예]에요)$", body):
        fs.append("ko-final")
    if REFUSALS.search(clause):
        fs.append("declines")
    if COURTESIES.search(clause):
        fs.append("courteous")
    return tuple(fs), language(clause)


#: Letters of a run that is looked for in the question.
_RUN = 5


def _runs(s: str) -> set[str]:
    return {s[i : i + _RUN] for i in range(len(s) - _RUN + 1)}


def _overlap(s: str, asked: str, runs: set[str]) -> float:
    """The share of a clause's runs of five letters that the question holds."""
    if len(s) < _RUN:
        return float(bool(s) and s in asked)
    n = len(s) - _RUN + 1
    return sum(s[i : i + _RUN] in runs for i in range(n)) / n


#: What a label before a repeated question ends with; a word alone may also end with a point or bracket, as in "Q1.".
_LABEL_SIGN = re.compile(r"[:：=＝>»|\-–—\]】)）\n]\s*$")
_LABEL_WORD = re.compile(r"^\W*\w+[.)）]\s*$")
_OPENING = "\"'“‘「『《«„([【（"


def repeats(question: str, answer: str) -> bool:
    """Is the answer nothing but the question, once or more, and at most a label before it? Formatting doesn't count."""
    asked, said = squeeze(question), squeeze(answer)
    if not asked or not said.endswith(asked):
        return False
    rest = len(said)
    while rest >= len(asked) and said[rest - len(asked) : rest] == asked:
        rest -= len(asked)
    if not rest:
        return True
    left = 0
    for at, c in enumerate(answer):  # where the letters before the question end in the answer as it is written
        left += len(squeeze(c))
        if left > rest:
            break
    before = answer[:at].rstrip().rstrip(_OPENING)
    return bool(_LABEL_SIGN.search(before) or _LABEL_WORD.match(before)) and len(clauses(before)) == 1


def _pair(question: str, answer: str) -> tuple[list[str], list[list[str]], list[dict]]:
    """Clauses of an answer, the features they have beside their own, and the facts that labels are derived from."""
    parts = clauses(answer)
    asked = squeeze(question)
    asked_runs = _runs(asked)
    q_lang, a_lang = language(question), language(answer)
    whole = repeats(question, answer)  # then every clause echoes
    features, facts = [], []
    for i, c in enumerate(parts):
        s = squeeze(c)
        own, lang = _own(masked(c))
        if lang == "zh" and a_lang == "ja":
            lang = "ja"
        foreign = not same_language(q_lang, lang) and not written_in(c, q_lang)
        contained = whole or len(s) >= 3 and s in asked
        overlap = 1.0 if contained else _overlap(s, asked, asked_runs)
        last = i == len(parts) - 1
        bucket = "all" if contained else str(int(overlap * 5))
        features.append([f"o={bucket}", f"f={foreign}", f"last={last}", f"lastmark={last}{_own_mark(c)}{'ko-final' in own}", f"first={i == 0}", f"of={bucket}{foreign}", f"whole={whole}"])
        facts.append({"contained": contained, "overlap": overlap, "foreign": foreign, "letters": len(s), "whole": whole})
    return parts, features, facts


def _mark(bare: str) -> str:
    """The mark a clause ends with; several dots are one mark, and not a full stop."""
    if bare.endswith(("..", "…")):
        return "dots"
    return bare[-1] if bare and bare[-1] in ".!?。！？,;:、，・-~" else ""


def _own_mark(clause: str) -> str:
    mark = _mark(_TERMINAL.sub("", clause))
    return "t" if mark and mark in ".!?。！？" else "n"


def _label(clause: str, fact: dict) -> str:
    if REFUSALS.search(clause) and not fact["whole"]:
        return REFUSAL
    if fact["whole"] or fact["letters"] >= 8 and (fact["contained"] or fact["overlap"] > 0.6):
        return ECHO
    if fact["foreign"]:
        return FOREIGN
    if COURTESIES.search(clause):
        return COURTESY
    return ECHO if fact["contained"] else ANSWER


def train(sample: list[tuple[str, str]]) -> crf.ChainCRF:
    """The field, from (question, answer) pairs; the same pairs give the same field."""
    features, gold, lengths = [], [], []

    def add(question: str, answer: str, cut: bool) -> None:
        parts, fs, facts = _pair(question, answer)
        if not parts:
            return
        labels = [_label(c, f) for c, f in zip(parts, facts)]
        if cut and labels[-1] != FOREIGN:
            labels[-1] = UNFINISHED
        features.extend([*_own(masked(c))[0], *extra] for c, extra in zip(parts, fs))
        gold.extend(labels)
        lengths.append(len(parts))

    for question, answer in sample:
        parts = clauses(answer)
        if not parts or not _own_mark(parts[-1]) == "t":
            continue  # whether this one is finished isn't known
        h = zlib.crc32(answer.encode())
        add(question, answer, False)
        if h % 5 == 0:  # copies of the question, bare or behind a label
            add(question, ("", "문의하신 내용: ", "Q. ", "Question: ")[(h >> 3) % 4] + question, False)
        if h & 1:
            add(question, answer.rstrip(" .!?。！？"), False)  # finished, though without its stop
        last = parts[-1].rstrip(" .!?。！？")
        if len(last) > 6 and not COURTESIES.search(last):
            at = 2 + (h >> 8) % (len(last) - 3)
            tail = ["", "", "…", ",", "...", ".", " "][(h >> 4) % 7] if not h & 2 else ""
            head = answer[: answer.rfind(last[:4])] if last[:4] in answer else ""
            broken = head + last[:at].rstrip() + ("" if tail == "." else tail)
            if not _finished_like(last, at):
                add(question, broken, True)
    return crf.fit(TAGS, features, gold, lengths, least=3, penalty=1e-5)


def _finished_like(clause: str, at: int) -> bool:
    """Would the clause broken off here look finished (a Korean predicate's end)?"""
    return bool(re.search(r"(니다|세요|십시오|까요)$", clause[:at]))


def defect(tagged: list[tuple[str, str]], answer: str | None) -> str | None:
    """The defect of an answer, from its (clause, tag) list; None if it has none.

    In this order: nothing said is empty; echo alone is a copy; declining without answering is a
    refusal; mostly another language; a last clause that breaks off.
    """
    if answer is None or squeeze(answer) in PLACEHOLDERS:
        return EMPTY
    weight = {t: 0 for t in TAGS}
    for clause, tag in tagged:
        weight[tag] += len(squeeze(clause))
    total = sum(weight.values()) - weight[COURTESY]
    if not total:
        return None
    if weight[ECHO] >= 0.9 * total:
        return COPY
    if weight[REFUSAL] and not weight[ANSWER] + weight[FOREIGN] + weight[UNFINISHED]:
        return REFUSAL
    if weight[FOREIGN] > 0.5 * total:
        return OTHER_LANGUAGE
    if tagged[-1][1] == UNFINISHED:
        return TRUNCATED
    return None


class Tagger:
    """Finds the defects of pairs with a trained field. The feature numbers of clauses met before are kept with it,
    for another field numbers its features otherwise."""

    #: Clauses remembered before they are forgotten; this bounds memory and changes no result.
    REMEMBERED = 100_000

    def __init__(self, model: crf.ChainCRF):
        self.model = model
        self.known: dict[str, list[int]] = {}

    def __reduce__(self):
        return Tagger, (self.model,)

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The defect of each (question, answer)."""
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        rows, lengths, parts = [], [], []
        for question, answer in pairs:
            p, fs, _ = _pair(question or "", answer) if answer and squeeze(answer) not in PLACEHOLDERS else ([], [], [])
            for c, extra in zip(p, fs):
                k = masked(c)
                own = self.known.get(k)
                if own is None:
                    own = self.known[k] = self.model.numbers(_own(k)[0])
                rows.append(own + self.model.numbers(extra))
            parts.append(p)
            lengths.append(len(p))
        tags = iter(self.model.decode(rows, lengths))
        return [defect([(c, next(tags)) for c in p], answer) for p, (_, answer) in zip(parts, pairs)]


def tag_batch(model: crf.ChainCRF | Tagger, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
    """The defect of each pair."""
    return (model if isinstance(model, Tagger) else Tagger(model)).defects(pairs)


def pair_defects(df: DataFrame, key: str, question: str, answer: str, version: str | None = None, training_pairs: int = TRAINING_PAIRS) -> DataFrame:
    """(key, defect): one row per defective pair.

    ``df`` holds the pairs to judge. Of a key loaded several times the row of the smallest ``version``
    counts. A null question is treated as empty: nothing echoes it, no language differs from it. Pairs
    without a defect have no row; an empty table gives none.
    """
    kind = dict(df.dtypes)[key]
    vkind = dict(df.dtypes)[version] if version else "int"
    rows = df.select(F.col(key).alias("k"), (F.col(version) if version else F.lit(0)).alias("v"), F.col(question).alias("q"), F.col(answer).alias("a"))
    script = F.when(F.col("a").rlike("[가-힣]"), 0).when(F.col("a").rlike("[ぁ-ヿ一-鿿]"), 1).when(F.col("a").rlike("[A-Za-z]"), 2).otherwise(3)
    order = Window.partitionBy("script").orderBy("h", "k", "a")  # each task keeps its first few of each script before the shuffle
    numbered = rows.filter(F.col("a").isNotNull()).withColumns({"script": script, "h": F.xxhash64("k", F.lit(23))}).withColumn("n", F.row_number().over(order))
    drawn = numbered.filter(F.col("n") <= training_pairs).select("q", "a", "h", "k").collect()
    model = train([(r[0] or "", r[1]) for r in sorted(drawn, key=lambda r: (r[2], str(r[3]), r[1]))])
    shared = df.sparkSession.sparkContext.broadcast(Tagger(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = tag_batch(shared.value, list(zip(b.column(2).to_pylist(), b.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["k", "v", "defect"])

    tagged = rows.mapInArrow(run, f"k {kind}, v {vkind}, defect string")
    # The versions of a key meet as narrow rows; the texts are never shuffled.
    one = tagged.groupBy("k").agg(F.min(F.struct("v", "defect"))["defect"].alias("defect"))
    return one.filter(F.col("defect").isNotNull()).select(F.col("k").alias(key), "defect")
