"""One consistent form for text that looks alike (problem 8).

The form is computed per text, in three steps:

1. *Loose forms*: line by line decomposition (NFD), width and joined forms
   (full-width, half-width, ligatures, presentation forms, styled letters,
   Roman numerals) replaced by their plain letters, every kind of blank by
   U+0020, look-alike hyphens by ``-``, invisible characters removed.
2. *Skeleton*: every look-alike letter becomes the representative of its class.
   Classes join letters of one case and one prototype of the Unicode security
   data over all scripts (``confusables``), one letter of each script: so texts
   of one script never lose a distinction.  Of several letters of a script the
   ASCII letter is in the class, else the one whose other case is a look-alike
   too (omicron and not sigma), else the first; the others are *weak* members
   (but for styled Latin letters, such as script or phonetic ones).
3. *Script spelling*: each token's resolved script set is the intersection of
   its letters' script sets (with extensions; Han, kana and hangul share the
   sets of Japanese, Korean and Bopomofo writing), where a letter counts for
   all scripts that have a letter of its class.  A token whose set is one
   script is spelt in it.  A token whose set holds several (a whole-script
   confusable) is spelt in the one that the text's decided tokens use most.  In
   a token whose set is empty some letters are impostors: weak members give way
   to their class's representative (``c\u03c3ffee`` is ``coffee``, while a Greek
   word keeps its sigma), and if that resolves it, it is spelt like the others.
   A token that stays mixed keeps the representatives.

Null in, null out; an empty text stays empty.  Letter case, accents, digits
and line breaks are kept; CRLF and LF are different line breaks here.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import regex

from chronoraster.llm import confusables

# Letters of other scripts that are drawn like a Latin letter, in
# pairs "other Latin"; they add to the Unicode security data, or stand in for
# them where they are not to be had.
CYRILLIC_TWINS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW ҮY ԌG ӀI "
    "аa сc ԁd еe һh іi јj оo рp ԛq ѕs ѵv ԝw хx уy ӏl"
)
GREEK_TWINS = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ρp αa ϲc ϳj ϱp"
ARMENIAN_TWINS = "ՍU ՏS ՕO օo սu հh ցg ոn յj զq"
CHEROKEE_TWINS = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᏆI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"
# Names of Latin letters that are drawn like another Latin letter, and blocks of phonetic and
# medievalist ones, which no living spelling tells from the plain letters.
STYLED_NAME = regex.compile(r"LATIN (SMALL )?LETTER (SCRIPT|ALPHA|IOTA|SMALL CAPITAL)\b")
STYLED_BLOCKS = ((0x1D00, 0x1DBF), (0x1E9C, 0x1E9D), (0x1EFA, 0x1EFF), (0xA730, 0xA7FF), (0xAB30, 0xAB6F))
HYPHENS = "‐‑‒–−⁃˗﹘﹣－"
# Invisible although not of category Cf: joiners, fillers, variation selectors.
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"
PLAIN_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


#: Latin, Cyrillic and Greek come first where a text decides nothing.
FIRST = ("Latin", "Cyrillic", "Greek")
# Writing systems that use several scripts.
AUGMENTED = {"Han": ("Hanb", "Jpan", "Kore"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)}


def _script_names() -> list[str]:
    """Scripts by name: those words that begin letters' names and are scripts to the pattern library."""
    words = set()
    for cp in range(0x41, sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] == "L" and not 0x4E01 <= cp <= 0x9FFF and not 0x20001 <= cp <= 0x3FFFF and not 0xAC01 <= cp <= 0xD7A3:
            parts = unicodedata.name(chr(cp), "").split()
            words |= {"_".join(parts[:k]) for k in (1, 2, 3)}
    out = []
    for w in sorted({*words, "HAN", "HANGUL"} - {"", "COMMON", "INHERITED"}):
        try:
            regex.compile(rf"\p{{scx={w}}}")
            out.append(w.title())
        except regex.error:
            pass
    return out


@lru_cache(maxsize=1)
def script_patterns() -> dict[str, regex.Pattern]:
    return {n: regex.compile(rf"\p{{scx={n}}}") for n in (_now.names if _now else _script_names())}


@lru_cache(maxsize=None)
def scripts_of(ch: str) -> frozenset[str]:
    """Scripts (and writing systems) that a letter is used in as written; empty for letters of all scripts. Bounded by the number of characters."""
    if ch.isascii():
        return frozenset(("Latin",))
    own = {s for s, p in script_patterns().items() if p.match(ch)}
    return frozenset(own.union(*(AUGMENTED.get(s, ()) for s in own)))


def _pairs(s: str) -> list[tuple[str, str]]:
    return [(p[0], p[1]) for p in s.split() if p[0] != p[1]]


def _styled(ch: str) -> bool:
    name = unicodedata.name(ch, "")
    return bool(STYLED_NAME.match(name)) or name.startswith("LATIN") and any(a <= ord(ch) <= z for a, z in STYLED_BLOCKS)


class Classes:
    """names: scripts; strong, weak: letter -> representative; spelling: script -> {representative: the script's letter}."""

    def __init__(self, prototypes: dict[str, str]):
        self.names = list(script_patterns())
        self.strong: dict[str, str] = {}
        self.weak: dict[str, str] = {}
        self.spelling: dict[str, dict[str, str]] = {}
        pairs = [p for t in (CYRILLIC_TWINS, GREEK_TWINS, ARMENIAN_TWINS, CHEROKEE_TWINS) for p in _pairs(t)]
        proto = {c: prototypes.get(c, c) for c in {*prototypes, *(chr(i) for i in range(0x41, 0x7B)), *(c for p in pairs for c in p)}}
        proto |= {c: p for c, p in ((p, p) for p in prototypes.values() if len(p) == 1) if c not in proto}
        fixed = {own for own, _ in pairs}
        for own, latin in pairs:
            proto[own] = proto[latin]
        groups: dict[tuple[str, str], list[str]] = {}
        for ch in sorted(proto):
            if (k := confusables.kind(ch, proto[ch])) and len(unicodedata.normalize("NFKD", ch)) == 1 and unicodedata.normalize("NFKD", ch) == ch:
                groups.setdefault((proto[ch], k), []).append(ch)
        for (_, k), letters in groups.items():
            by_script: dict[str, list[str]] = {}
            styled = set(filter(_styled, letters))
            rep = next((c for c in letters if c.isascii()), next((c for c in letters if c not in styled), letters[0]))
            for ch in letters:
                for s in scripts_of(ch) if ch not in styled else ():
                    by_script.setdefault(s, []).append(ch)
            other = proto.get(rep.swapcase(), rep.swapcase())
            main = {s: min(cs, key=lambda c: (not c.isascii(), len(c.swapcase()) != 1 or proto.get(c.swapcase(), c.swapcase()) != other, c)) for s, cs in by_script.items()}
            if len(set(main.values())) < 2 and len(letters) < 2:
                continue
            for ch in letters:
                if ch == rep:
                    continue
                if ch in fixed or ch in styled or all(main[s] == ch for s in scripts_of(ch)):
                    self.strong[ch] = rep
                else:
                    self.weak[ch] = rep
            for s, ch in main.items():
                if ch == rep or ch in self.strong:
                    self.spelling.setdefault(s, {})[rep] = ch
        self.scripts: dict[str, frozenset[str]] = {}
        for s, letters in self.spelling.items():
            for rep in letters:
                self.scripts[rep] = self.scripts.get(rep, frozenset()) | {s}


_now: Classes | None = None


def classes() -> Classes:
    """The classes in use: those sent by ``install``, else made here, once a process."""
    global _now
    if _now is None:
        _now = Classes(confusables.prototypes())
    return _now


def install(sent: Classes) -> None:
    """Take over the driver's classes, in a task."""
    global _now
    if _now is None:
        _now = sent


@lru_cache(maxsize=1)
def loose_table() -> dict[int, str]:
    """code point -> plain form, built from the Unicode database by rule."""
    table: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Zs":
            table[cp] = " "
        elif cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180D or ch in INVISIBLE_EXTRA:
            table[cp] = ""
        else:
            how = unicodedata.decomposition(ch)
            tag = how.split(" ", 1)[0] if how.startswith("<") else ""
            ligature = tag == "<compat>" and cat in ("Ll", "Lu", "Lt", "Lo") and len(how.split()) >= 3
            numeral = tag == "<compat>" and cat == "Nl"  # Roman numerals
            if tag in PLAIN_TAGS or ligature or numeral:
                table[cp] = unicodedata.normalize("NFKD", ch)
    table |= {ord(c): "-" for c in HYPHENS}
    table[0x00B5] = "μ"  # micro sign, drawn as the Greek letter
    table[0x09] = " "
    return table


@lru_cache(maxsize=1)
def skeleton_table() -> dict[int, str]:
    """``loose_table`` followed by the look-alike classes, as one mapping."""
    strong = {ord(a): b for a, b in classes().strong.items()}
    return {cp: s.translate(strong) for cp, s in loose_table().items()} | strong


_TOKEN = regex.compile(r"[\p{L}\p{M}]+")


@lru_cache(maxsize=None)
def _plain(ch: str) -> str:
    """One character's skeleton; the cache is bounded by the number of characters."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch).translate(skeleton_table()))


@lru_cache(maxsize=None)
def _decides(ch: str) -> bool:
    """Can this character of a skeleton change how tokens are spelt?"""
    base = unicodedata.normalize("NFD", ch)[0]
    return unicodedata.category(base)[0] == "L" and ("Latin" not in class_scripts(base) or base in classes().weak)


def skeleton(text: str | None) -> str | None:
    """Letters in their class's representative, before tokens are resolved."""
    if text is None or text.isascii():
        return text if text is None or "\t" not in text else text.replace("\t", " ")
    text = unicodedata.normalize("NFC", text)
    for ch in set(text):
        if ch > "\x7f" or ch == "\t":
            new = _plain(ch)
            if new != ch:
                text = text.replace(ch, new)
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=None)
def class_scripts(ch: str) -> frozenset[str]:
    """Scripts that have a letter of this skeleton letter's class; empty for letters of all scripts."""
    own = scripts_of(ch)
    return own | classes().scripts.get(ch, frozenset()) if own else own


def _common(sets) -> frozenset[str]:
    left = None
    for s in sets:
        if s:
            left = s if left is None else left & s
    return frozenset() if left is None else left


def _letters(token: str) -> list[str]:
    return [c for c in token if unicodedata.category(c)[0] == "L"]


@lru_cache(maxsize=100_000)
def resolve(token: str) -> tuple[str, frozenset[str]]:
    """(token, its script set): of a decomposed skeleton token, weak members replaced if only that resolves it."""
    left = _common(map(class_scripts, _letters(token)))
    if not left:
        weak = classes().weak
        plain = "".join(weak.get(c, c) for c in token)
        if plain != token and (other := _common(map(class_scripts, _letters(plain)))):
            return plain, other
    return token, left


def resolved_scripts(token: str) -> frozenset[str]:
    return resolve(token)[1]


@lru_cache(maxsize=100_000)
def _spell(token: str, script: str) -> str:
    own = classes().spelling.get(script)
    return "".join(own.get(c, c) for c in token) if own else token


def spell(skel: str) -> str:
    """Step 3 on a skeleton."""
    if skel.isascii() or not any(c > "\x7f" and _decides(c) for c in set(skel)):
        return skel  # every token is spelt in Latin, in which the representatives are
    text = unicodedata.normalize("NFD", skel)
    tokens = Counter(_TOKEN.findall(text))
    found = {t: resolve(t) for t in tokens}
    votes = Counter()
    for t, n in tokens.items():
        if len(s := found[t][1]) == 1:
            votes[next(iter(s))] += n

    def rank(script: str):
        return -votes[script], FIRST.index(script) if script in FIRST else len(FIRST), script

    def put(m) -> str:
        t, s = found[m.group()]
        return _spell(t, min(s, key=rank)) if s else t

    return unicodedata.normalize("NFC", _TOKEN.sub(put, text))


def consistent_form(text: str | None) -> str | None:
    s = skeleton(text)
    return None if s is None else spell(s)


@lru_cache(maxsize=100_000)
def _written(token: str) -> tuple[bool, bool]:
    letters = _letters(token)
    own = _common(map(scripts_of, letters))
    if not own:
        return any(map(scripts_of, letters)), False
    strong = classes().strong
    return False, bool(_common(class_scripts(strong.get(c, c)) for c in letters) - own)


def mixed_tokens(text: str | None) -> tuple[int, int]:
    """(tokens that mix scripts, tokens of one script that could be another's) as written; tokens of ASCII letters do not count."""
    if text is None or text.isascii():
        return 0, 0
    found = [_written(t) for t in _TOKEN.findall(unicodedata.normalize("NFD", text)) if not t.isascii()]
    return sum(m for m, _ in found), sum(w for _, w in found)
