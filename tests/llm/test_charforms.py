from __future__ import annotations

import json

from quillspark.llm import charforms as C


def test_one_form():
    assert C.one_form("plain") == "plain" and C.one_form("") == ""
    assert C.one_form("ｐｅｂｂⅼes​  a­b﻿") == "pebbles  ab"
    assert C.one_form("Тһе ԝіnԁ") == "The wind"
    assert C.one_form("café") == "café"
    assert C.one_form("е́") == "é"
    # what can be seen stays
    for kept in ("①", "²", "é", "“x” — y", "a  b\n\nc\td", "A", "½", "ﬁ"):
        assert C.one_form(kept) == kept
    assert C.one_form("x y　z") == "x y z"
    assert C.one_form("a\x01b") == "ab"


def test_bars_by_their_neighbours():
    assert C.one_form("Ӏvan ran. Ӏ saw HEӀL, heӀӀo and Ɩt, aƖӀ") == "Ivan ran. I saw HEIL, hello and It, all"
    assert C.one_form("ӏamp heӏӏo") == "lamp hello"


def test_only_greek_and_cyrillic_words_read_v_as_n():
    assert C.letters_and_digits("vest") != C.letters_and_digits("nest")
    assert C.letters_and_digits(C.one_form("a νest")) == b"avest"
    assert C.letters_and_digits(C.one_form("νερό")) == C.letters_and_digits(C.one_form("ΝΕΡΌ"))


def test_words_and_letters():
    assert C.words("Don't stop, Ｃafé-42!") == ["dont", "stop", "café", "42"]
    assert C.words("小さな猫が「こんにちは」") == ["小さな猫が", "こんにちは"]
    assert C.letters_and_digits("A-b_c 1²") == "abc1²".encode()
    assert C.count_letters_and_digits("é²".encode()) == 2
    for text in ("Тон и Νон τον", "straße ΣΑΣ ѵ v", "ＡＢ ⅰⅼ"):
        assert C.letters_and_digits(C.one_form(text)) == C.letters_and_digits(C.one_form(text.upper())) == C.letters_and_digits(C.one_form(text.lower()))


FIELDS = {"Words": "fox, pond", "Features": "Twist", "Summary": "A fox swims in a village.", "Story": 'The fox said "hi"\nand swam.'}


def layouts(fields: dict) -> list[str]:
    return [
        json.dumps(fields),
        json.dumps(fields, ensure_ascii=False, indent=2),
        "\n".join(f"{k}: {v}" for k, v in fields.items()),
        " | ".join(f"{k}: {v}" for k, v in fields.items()),
        "\n\n".join(f"## {k}\n{v}" for k, v in fields.items()),
    ]


def test_records_in_any_layout_and_order():
    turned = dict(reversed(FIELDS.items()))
    keys = {C.record_key(C.one_form(t)) for f in (FIELDS, turned) for t in layouts(f)}
    assert len(keys) == 1
    loud = {C.record_key(C.one_form(t.upper())) for t in layouts(FIELDS)[2:]}
    assert loud == keys
    other = C.record_key(C.one_form(layouts({**FIELDS, "Words": "fox, lake"})[0]))
    assert other not in keys
    swapped = C.record_key(C.one_form(layouts({**FIELDS, "Words": FIELDS["Features"], "Features": FIELDS["Words"]})[0]))
    assert swapped not in keys


def test_plain_text_is_no_record():
    for text in ("Once upon a time: a story.", "Story: only one label", "{broken json", "", "The words: a, b. The summary: c."):
        assert C.record_fields(text) is None
