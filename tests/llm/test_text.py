"""Tokens, pieces, sentences, languages: the parts that need no Spark, against brute force and exact round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import crf, language, pairs, sentences, splitting, tokenize

HAS = os.path.isdir(tokenize.VOCABULARIES)
MIXED = st.text(alphabet="ab 's't've 가나다\n\t　\xa0é日本。！!?''1２½क्षि🙂‍️I.,-", max_size=60)


@pytest.fixture(scope="module")
def encoder():
    if not HAS:
        pytest.skip("no vocabularies here")
    return tokenize.encoder()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokenize.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@given(st.lists(st.none() | MIXED, max_size=8))
@settings(max_examples=200, deadline=None)
def test_forced_boundaries_equal_plain_encoding(encoder, reference, texts):
    want = [reference.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.encode(texts) == want


def test_special_tokens_are_text_and_bytes_come_back(encoder):
    texts = ["<|endoftext|> x", "\x00\x01", "가" * 5000, "a" * 200_000, "", None, "\r\n \r\n"]
    got = encoder.encode(texts)
    assert [encoder.bpe.decode(i) for i in got] == [t or "" for t in texts]
    assert got[4] == got[5] == []


def test_remembered_fragments_are_only_speed(encoder, monkeypatch):
    texts = [f"word{i} 단어{i}" for i in range(50)]
    want = encoder.encode(texts)
    monkeypatch.setattr(tokenize, "REMEMBERED", 1)
    assert [encoder.encode([t])[0] for t in texts] == want


@given(st.text(alphabet="ab. \n\r가나👩‍🔧é́,;。", max_size=200), st.integers(2, 30), st.integers(0, 29))
@settings(max_examples=300, deadline=None)
def test_pieces_round_trip(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in pieces) == text
    assert all(0 < e - s <= limit for s, _, e, _ in pieces)
    for (s0, _, e0, _), (s1, c1, _, _) in zip(pieces, pieces[1:]):
        assert c1 == e0 and e0 - s1 == min(overlap, e0 - s0)


def test_headings_divide_and_decoys_do_not():
    text = "첫 조항입니다.\r\n\r\n제6-14조(선물 변경)\n내용.\n제6-6조에 따른 환불은 됩니다.\n6-15. 처리 절차\n내용\n2-4일 안에 답합니다.\n[6-17] 적용 범위\n## 6-18 제목\n끝"
    assert [a for _, a in splitting.headings(text)] == ["6-14", "6-15", "6-17", "6-18"]
    pieces = splitting.split_text(text, 600, 60)
    assert [a for *_, a in pieces] == [None, "6-14", "6-15", "6-17", "6-18"]
    starts = {at for at, _ in splitting.headings(text)}
    assert all(not any(c < s < e for s in starts) for _, c, e, _ in pieces)


def test_natural_boundaries_come_first():
    text = ("가나다 " * 20 + "끝납니다. ") * 20
    cuts = [e for _, _, e, _ in splitting.split_text(text, 300, 30)][:-1]
    assert all(text[:c].endswith("끝납니다. ") for c in cuts)
    emoji = "👩‍🔧" * 400
    assert all(e % 3 == 0 for _, _, e, _ in splitting.split_text(emoji, 100, 10))


@pytest.mark.parametrize("text, code", [("안녕하세요 ORD-2024", "ko"), ("お元気ですか", "ja"), ("订单已于8月9日发货", "zh"), ("The order is here", "en"), ("Ihre Bestellung wurde versandt", "de"), ("Su pedido salió del almacén", "es"), ("สวัสดี", "th"), ("12 !?", ""), ("moss1@x.org 메일", "ko")])
def test_language(text, code):
    assert language.language(text) == code


def test_crf_learns_a_chain_and_equals_brute_force():
    random.seed(0)
    gold, features, lengths = [], [], []
    for _ in range(60):
        n = random.randint(1, 6)
        tags = [random.choice("AB")]
        for _ in range(n - 1):
            tags.append("B" if tags[-1] == "A" else "A")  # only the chain tells the later ones
        gold += tags
        features += [[f"x={tags[0]}"]] + [["y"] for _ in range(n - 1)]
        lengths.append(n)
    m = crf.fit(["A", "B"], features, gold, lengths)
    assert m.decode([m.numbers(f) for f in features], lengths) == gold
    import itertools

    import numpy as np

    rows = [m.numbers(f) for f in [["x=A"], ["y"], ["y"], ["z"]]]
    s = m.scores(*m.indexed(rows))
    best = max(itertools.product(range(2), repeat=4), key=lambda p: m.start[p[0]] + sum(s[i, k] for i, k in enumerate(p)) + sum(m.transitions[a, b] for a, b in zip(p, p[1:])))
    assert list(m.viterbi(s, np.array([4]))) == list(best)
    assert m.decode([], []) == []


CASES = [
    "Mr. Brown waited until 5:30 p.m. and went home.| (Dr. Green saw this.)| It costs 4.50 now!| “Stop! Leave it.” said Ann.| The clerk asked: “Who is it?”| Then he left.",
    "가게는 오전 9시에 문을 엽니다.| “멈춰요! 두세요.” 하고 말했다.| (심가람이 확인함.)| 2024. 4. 3. 자 공문이 있음.",
    "店は午前9時に開きます。|田中さんは「止まれ！置け。」と言った。|（朝霧さんが確認した。）|今何時ですか？",
    "商店上午9点开门。|店员问：“现在要4.50元。”|“停下！”王老师说。|（王老师已确认。）",
]


@pytest.fixture(scope="module")
def model():
    # Training from list items alone, as the smallest corpus might have.
    lines = [p.strip() for c in CASES for p in c.split("|") if "“" not in p and "「" not in p]
    return sentences.train(["\n".join(f"{i + 1}. {x}" for i, x in enumerate(lines))] * 2 + [x for x in lines])


@pytest.mark.parametrize("marked", CASES)
def test_sentences(model, marked):
    text = marked.replace("|", "")
    want, at = [], 0
    for part in marked.split("|"):
        want.append(at + len(part) - len(part.lstrip()))
        at += len(part)
    assert sentences.starts_of(model, [text])[0] == want


def test_sentence_structure(model):
    text = "  Title here\n\nOne line\ngoes on.\n1. First item\n2. Second. item\n\nlast piece"
    got = sentences.starts_of(model, [text, "", None, " \n\t"])
    assert [text[p : p + 5] for p in got[0]] == ["Title", "One l", "1. Fi", "2. Se", "last "] or [text[p : p + 5] for p in got[0]][:4] == ["Title", "One l", "1. Fi", "2. Se"]
    assert got[1:] == [[], [], []]
    assert sentences.list_items("Am\n3. Mai kam er.") == {}


@pytest.mark.parametrize("marks, inner", [("“”", "He waited. "), ("「」", "待っていた。"), ("()", "Someone saw it. "), ('""', "He waited. "), ("«»", "Er wartete. ")])
@pytest.mark.parametrize("times", [3, 30, 90])
def test_quotations_of_any_length_stay_one(marks, inner, times):
    text = f"Ann said: {marks[0]}{inner * times}{marks[1]} and left."
    a = text.index(marks[0])
    assert sentences.spans(text) == [(a, text.rindex(marks[1]) + 1)]
    _, sure, open_ = sentences.places(text)
    assert not sure and all(p[0] == a or p[0] > text.rindex(marks[1]) for p in open_)


def test_nested_and_unclosed_quotations():
    text = "彼は「彼女が「はい。」と言った。」と言った。"
    assert sentences.spans(text) == [(2, text.rindex("」") + 1)]
    broken = "Ann said: “" + "He waited. " * 60 + "\n\nThen it rained."
    assert sentences.spans(broken) == [(10, broken.index("\n\n"))] or sentences.spans(broken)[0][0] == 10
    assert sentences.places(broken)[1] == [broken.index("Then")]
    assert sentences.spans("a (b c d. " + "x " * 400) == []


def test_zones_equal_those_of_every_character(model):
    """The shortcut over plain spaces finds the places that looking at every break zone finds."""
    texts = [c.replace("|", "") for c in CASES] + ["A (b.) c. “d.” E f! 3. G", "ก ข “ค ง” จ ฉ (ช.) ซ", "x\n1. a\n2. b\n\n c 🙂 d. e", ' “a.” b “c” d. ', "a  “b. c”  d"]
    for text in texts:
        whole = sentences.places(text)
        marks = sentences.spans(text)
        every = sorted({m.span() for m in sentences._ANY_ZONE.finditer(text, whole[0])} | {(b, b) for _, b in marks if b < len(text) and not sentences._ANY_ZONE.match(text, b)})
        kept = sentences._zones
        try:
            sentences._zones = lambda *_, z=every: z
            assert sentences.places(text) == whole
        finally:
            sentences._zones = kept


def test_scores_by_parts_equal_the_field(model):
    d = sentences.Decoder(model)
    d.REMEMBERED = 2
    text = CASES[0].replace("|", "")
    for _, seen in sentences.places(text)[2]:
        w = model.weights[model.numbers(sentences.features_of(seen))].sum(0)
        assert abs(d.score(seen) - (w[d.start] - w[d.inside])) < 1e-9


def test_counts_take_back_what_begins():
    c = sentences.StartCounts(["Now it rains. Now we go now and Now.", "Now again\n\nNow"])
    assert c.opens == {"latin:Now": 3} and c.open_places == {"latin:Now": 1} and c.middle["latin:Now."] == 1 and c.middle.get("latin:Now", 0) == 0


def test_decomposed_korean_shows_the_same_features():
    import unicodedata

    text = "가게는 오전 9시에 문을 엽니다. 지금 몇 시예요? 그 책은 여기 있다."
    nfd = unicodedata.normalize("NFD", text)
    a, b = sentences.places(text)[2], sentences.places(nfd)[2]
    assert len(a) == len(b) == 2
    for (_, x), (_, y) in zip(a, b):
        assert set(sentences.features_of(x)) == set(sentences.features_of(y))


@pytest.mark.parametrize("question, answer, same", [
    ("배송은 언제 되나요?", "배송은 언제  되나요", True), ("배송은 언제 되나요?", "고객님께서 보내 주신 문의하신 내용은 다음과 같습니다: 배송은 언제 되나요?", True), ("배송은 언제 되나요?", "Q1. 배송은 언제 되나요?", True), ("배송은 언제 되나요?", "[문의 내용]\n『배송은 언제 되나요?』", True),
    ("되나요?", "되나요?", True), ("배송은 언제 되나요?", "배송은 언제 되나요? 배송은 언제 되나요?", True), ("배송은 언제 되나요?", "내일 출고됩니다. 질문: 배송은 언제 되나요?", False), ("배송은 언제 되나요?", "『배송은 언제 되나요?』 문의 감사합니다. 내일입니다.", False), ("배송은 언제 되나요?", "네 배송은 언제 되나요?", False), ("", "", False), ("?", "내일", False),
])
def test_repeated_questions(question, answer, same):
    assert pairs.repeats(question, answer) is same


PAIRS = [(f"{w} 제품을 교환할 수 있나요? 번호는 {i}입니다.", a) for i, (w, a) in enumerate((w, a) for w in ("우산", "시계", "주전자", "가습기") for a in ("수령하신 날부터 7일 안에 교환하실 수 있습니다.", "영업일 기준 3일 안에 환불됩니다. 감사합니다.", "죄송하지만 답변을 드릴 수 없습니다.", "주문 취소는 상품준비중 단계까지만 가능하므로 취소가 어렵습니다."))]


def test_two_fields_in_one_process():
    """Numbers of features belong to the field that gave them, also after another field took its place in memory."""
    texts = [(q, a) for q, a in PAIRS] + [("언제 오나요?", "수령하신 날부터 7일 안에 교환하실 수")]
    want = None
    for turn in range(6):
        tagger = pairs.Tagger(pairs.train(PAIRS[turn % 2 :] * 3))
        got = tagger.defects(texts)
        assert got == tagger.defects(texts) == pairs.Tagger(tagger.model).defects(texts)
        want = want or got
        del tagger
    assert want[2] == "refusal" and want[3] is None


def test_overlap_covers_the_whole_clause():
    asked = pairs.squeeze("x" * 40 + "가나다라마바사아자차카타파하")
    clause = pairs.squeeze("가나다라마바사아자차카타파하" + "y" * 14)
    assert abs(pairs._overlap(clause, asked, pairs._runs(asked)) - 10 / 24) < 1e-9
    assert pairs._overlap("나다", asked, set()) == 1.0 and pairs._overlap("", asked, set()) == 0.0


@pytest.mark.parametrize("text", ["그 건에 관해서는 대답하지 않겠습니다.", "제가 처리할 수 있는 범위를 벗어납니다.", "제 권한 밖입니다.", "I won't be able to answer that.", "That is beyond what I can discuss.", "対応できる範囲を超えています。", "回答を差し控えます。", "这超出了我的服务范围。"])
def test_ways_to_decline(text):
    assert pairs.REFUSALS.search(text)


@pytest.mark.parametrize("text", ["주문 취소가 어렵습니다.", "규정상 환불은 불가합니다.", "앞서 안내해 드릴 수 없었던 부분까지 말씀드립니다.", "Opened items cannot be returned.", "返品できません。", "지역 범위는 안내문과 같습니다."])
def test_policies_that_forbid_are_answers(text):
    assert not pairs.REFUSALS.search(text)


def test_codes_glued_to_words_hide_no_language():
    assert language.language("ZP-005705のアロマ加湿器を交換できますか？") == "ja" and language.language("TA-000752가 아직") == "ko"


@pytest.mark.parametrize("n", [20, 119, 130, 2000])
def test_titles_of_any_length(n):
    title = ("가나다라 " * n)[:n].strip()
    text = f"첫 조항입니다.\n6-15. {title}\n내용입니다.\n6-16. {title}.\n끝"
    assert splitting.headings(text) == [(9, "6-15")]


def test_long_lines_without_headings_are_quick():
    import time

    began = time.time()
    assert splitting.headings(("6-15. " + "word " * 20_000 + ".\n") * 5) == []
    assert time.time() - began < 5


def test_viterbi_of_many_lengths_equals_one_at_a_time():
    import numpy as np

    rng = np.random.default_rng(2)
    m = crf.ChainCRF(["A", "B", "C"], {}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    for many in (1, 5, 60):
        lengths = np.concatenate([rng.integers(0, 6, many), rng.integers(20, 90, 3), [7] * 4])
        scores = rng.normal(size=(int(lengths.sum()), 3))
        at = np.concatenate([[0], np.cumsum(lengths)])
        alone = np.concatenate([m.viterbi(scores[a:b], np.array([b - a])) for a, b in zip(at, at[1:])])
        assert (m.viterbi(scores, lengths) == alone).all()
