"""One consistent character form of a text, and the keys built on it.

The *one form* keeps what a reader sees: invisible characters are gone, every special blank is an
ordinary space, width and look-alikes of letters do not count, accents are composed; case, accents,
raised or ringed digits, the number of blanks and line breaks stay.
"""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import blake2b

# Letters of other scripts that look like a Latin letter, by that letter.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ԁ", "E": "ЕΕ", "H": "НΗҺ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "L": "Լ",
    "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ",
    "Y": "ҮΥ", "Z": "Ζ", "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х",
    "y": "уү",
}
# Lower-case letters that only their capital makes a look-alike; they count where case is ignored.
CAPITAL_LOOKALIKES = {
    "a": "α", "b": "вβ", "e": "ε", "h": "нη", "i": "ι", "k": "кκ", "m": "мμ", "p": "ρ", "t": "тτ", "x": "χ",
    "y": "υ", "z": "ζ",
}
# Characters without ink that no general category marks.
BLANK_LETTERS = "͏ᅟᅠㅤﾠ឴឵"

_TO_LATIN = {ch: latin for latin, chars in LOOKALIKES.items() for ch in chars}
_CAPITALS = {ch: latin for latin, chars in CAPITAL_LOOKALIKES.items() for ch in chars}


def is_ignorable(ch: str) -> bool:
    """Whether a character shows nothing: format and control characters, variation selectors, blank letters."""
    kind = unicodedata.category(ch)
    return (
        kind == "Cf"
        or (kind == "Cc" and ch not in "\t\n\r\v\f\x85")
        or "︀" <= ch <= "️"
        or "\U000e0100" <= ch <= "\U000e01ef"
        or ch in BLANK_LETTERS
    )


def plain_character(ch: str) -> str:
    """The ordinary spelling of one character: nothing, a space, a look-alike's letter, or itself."""
    if is_ignorable(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in _TO_LATIN:
        return _TO_LATIN[ch]
    kind, _, parts = unicodedata.decomposition(ch).rpartition("> ")
    if kind in ("<wide", "<narrow", "<font") or (kind == "<compat" and unicodedata.category(ch) == "Nl" and " " not in parts):
        return "".join(plain_character(chr(int(x, 16))) for x in parts.split())
    base = unicodedata.normalize("NFD", ch)
    if len(base) > 1 and base[0] in _TO_LATIN:
        return unicodedata.normalize("NFC", _TO_LATIN[base[0]] + base[1:])
    return ch


class _Memo(dict):
    """Character -> replacement, computed once per character met."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, ch):
        self[ch] = out = self.of(ch)
        return out


_PLAIN = _Memo(plain_character)
#: Everything but printable ASCII, the usual blanks, precomposed Latin-1 letters and the common quotes and dashes.
_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ–—‘’“”]")


#: Characters that look like both I and l.
_BAR = re.compile("[ӀƖ]+")


def _bar(m: re.Match) -> str:
    """I where a capital would stand (at a word's beginning, beside capitals), else l; a run is read alike but for its
    beginning of a word before small letters."""
    before, after, n = m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1], m.end() - m.start()
    if before.isalpha():
        return ("I" if before.isupper() and not after.islower() else "l") * n
    return "I" + ("l" if after.islower() else "I") * (n - 1)


def one_form(text: str) -> str:
    """The one form of a text; the empty text is its own form."""
    if _ODD.search(text) is None:
        return text
    text = _BAR.sub(_bar, text)
    return unicodedata.normalize("NFC", _ODD.sub(lambda m: _PLAIN[m.group()], text))


def is_odd(token: str) -> bool:
    """Whether a token holds a character that may need another spelling."""
    return _ODD.search(token) is not None


_ASCII_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
_ASCII_FOLD = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
_BEYOND_ASCII = re.compile("[^\x00-\x7f]")
_FOLDED = _Memo(lambda ch: _CAPITALS.get(ch, ch) if ch.isalnum() else "")
_FOREIGN = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
#: A word in which a Greek or Cyrillic letter is left.
_FOREIGN_WORD = re.compile("[^\\W\\d_]*[\u0370-\u052f\u1f00-\u1fff][^\\W\\d_]*")
#: The Greek letter that looks like v has a capital that looks like N; in words of Latin letters v is v.
_NU = str.maketrans("vV", "nN")


def letters_and_digits(form: str) -> bytes:
    """Letters and digits of a one form in their order, case ignored, as UTF-8."""
    if not form.isascii():
        form = form.casefold()
        if _FOREIGN.search(form):
            form = _FOREIGN_WORD.sub(lambda m: m.group().translate(_NU), form)
        form = _BEYOND_ASCII.sub(lambda m: _FOLDED[m.group()], form)
    return form.encode("utf-8", "surrogatepass").translate(_ASCII_FOLD, _ASCII_DROP)


def count_letters_and_digits(flat: bytes) -> int:
    """Characters in what letters_and_digits returns."""
    return len(flat) if flat.isascii() else len(flat.decode("utf-8", "surrogatepass"))


_APOSTROPHES = "'’ʼ‘"
_SEPARATOR = _Memo(lambda ch: "" if ch in _APOSTROPHES else ch if ch.isalnum() else " ")
_OTHER = re.compile("[^\x00-\x7fß-öø-ÿ]")


def word_text(form: str) -> str:
    """Lower-case one form without apostrophes whose characters beyond ASCII are all letters or digits."""
    text = form.lower().replace("'", "")
    return text if text.isascii() else _OTHER.sub(lambda m: _SEPARATOR[m.group()], text)


_WORD = re.compile(r"[^\W_]+")
_BLANKS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words(text: str) -> list[str]:
    """Words of a raw text: runs of letters and digits of its one form in lower case, apostrophes left out."""
    return _WORD.findall(word_text(one_form(text)))


def word_key(text: str) -> bytes:
    """16 bytes for a text as of word_text, equal for the same sequence of words."""
    return blake2b(b" ".join(text.encode("utf-8", "surrogatepass").translate(_BLANKS).split()), digest_size=16).digest()


#: Labels of the corpus' records; a parameter of the functions below.
LABELS = ("words", "features", "summary", "story", "age")


def _label_pattern(labels: tuple[str, ...]) -> re.Pattern:
    name = "|".join(map(re.escape, labels))
    return re.compile(rf"(?:\A|[\n|]|(?<=\s))[\s*_~]*(?:#+[\s*_~]*({name})(?![^\W_])[\s*_~]*:?|({name})[\s*_~]*:)", re.I)


_PATTERNS: dict[tuple[str, ...], tuple[re.Pattern, re.Pattern]] = {}


def record_fields(form: str, labels: tuple[str, ...] = LABELS) -> list[tuple[str, str]] | None:
    """(label, value) of a record of labelled fields in any layout (JSON object, headed sections, 'label: value' with
    lines or bars between); None if the text is no such record: it needs at least two labels and begins with one."""
    start = form.lstrip()[:1]
    if start == "{":
        try:
            parsed = json.loads(form.strip(), strict=False)
        except ValueError:
            parsed = None
        if isinstance(parsed, dict) and len(parsed) > 1:
            return [(str(k), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in parsed.items()]
        return None
    if labels not in _PATTERNS:
        _PATTERNS[labels] = re.compile(rf"[\s*_~#|]*(?:{'|'.join(map(re.escape, labels))})", re.I), _label_pattern(labels)
    begins, each = _PATTERNS[labels]
    if begins.match(form) is None:
        return None
    found = list(each.finditer(form))
    if len(found) < 2 or form[: found[0].start()].strip(" \t\r\n*_~#") or len({(m[1] or m[2]).lower() for m in found}) < len(found):
        return None
    ends = [m.start() for m in found[1:]] + [len(form)]
    return [((m[1] or m[2]), form[m.end() : e]) for m, e in zip(found, ends)]


def field_key(form: str, labels: tuple[str, ...] = LABELS) -> bytes | None:
    """16 bytes that are equal for records of labelled fields with the same values, in any order and layout; None for
    other texts."""
    fields = record_fields(form, labels)
    if fields is None:
        return None
    flat = b"\x01" + b"\x02".join(sorted(letters_and_digits(k) + b"\x03" + letters_and_digits(v) for k, v in fields))
    return blake2b(flat, digest_size=16).digest()


def flat_key(flat: bytes) -> bytes:
    """16 bytes that are equal for equal letters and digits."""
    return blake2b(flat, digest_size=16).digest()


def record_key(form: str, flat: bytes | None = None, labels: tuple[str, ...] = LABELS) -> bytes:
    """16 bytes that are equal for the same record: of the sorted labelled fields, else of the letters and digits."""
    return field_key(form, labels) or flat_key(letters_and_digits(form) if flat is None else flat)
