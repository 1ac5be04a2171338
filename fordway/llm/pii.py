r"""PII: detection in the text as it stands and in a deobfuscated form whose spans map back to the source.

Plain detection (`plain_spans`) gives, leftmost and without overlap for each kind: e-mail addresses, IPv4 addresses,
card numbers (12 to 19 digits passing Luhn), phone numbers (+ and 9 to 15 digits). A match failing its test is dropped
and not tried again from a later character.

Deobfuscation (`normalise`) is a cascade of finite-state transducers; each writes normal characters and, for each, the
source span it came from. The first, of one state, folds homoglyphs (styled forms by Unicode's own mappings, letters of
other scripts that look Latin, other digits) and leaves out invisible characters. The others read tokens and are
determinised as they meet them: disguises of @ and dot in brackets ("[at]", "(dot)"), spelled digits in a row, a spelled
plus and dots between numbers, and the bare words in "name at host dot org" and "j.doe at host.org". The detectors run
over the output; what they find there by way of a change, and what overlaps no plain span of its kind, is added with
its source span.

Null and empty texts have no spans. Rows are independent: ties, repeated rows, null or repeated ids and empty tables
need no care. Only id and text are read. All patterns take time in proportion to the text: each run of characters is
looked at from its start only.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")

LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @: the local part is the run of its characters before, as far as the last match's end."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (domain := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in LOCAL_SET:
                start -= 1
            if start < at:
                end = domain.end()
                found.append(Span("email", start, end))
        at = text.find("@", at + 1)
    return found


def plain_spans(text: str) -> list[Span]:
    found = emails(text)
    found += [Span("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(x) for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(Span("phone", m.start(), m.end()))
    return in_order(found)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


# Letters of other scripts and the ASCII ones they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһӏԍԛԝкмнтвгԚԜҺӀԌ", "ABESIJKMHOPCTYXaesijopcyxdhlgqwkmhtbrQWHlG", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονικρυχωϲγ", "ABEZHIKMNOPTYXCjovikpuxwcy", strict=True))
ARMENIAN = dict(zip("ՍՕոսցօհզ", "UOnugohq", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏆᏒᏔᏕᏙᏚᏞᏟᏢᏦᏭ", "DRTiAJEWMHYGhZIRWSVSLCPKG", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
LATIN = dict(zip("ıɑɡɩɪʏʀʟɴɢʙʜᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜱ", "iagiiyrlngbhacdejkmoptuvwzs", strict=True))
LOOKALIKES = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LISU | LATIN


def compatible(c: int) -> str | None:
    """The ASCII letter, digit or sign that a character is a styled form of (full-width, mathematical, circled, raised,
    long s, Kelvin sign and so on), by Unicode's own compatibility mappings; letters with accents are none."""
    plain = unicodedata.normalize("NFKC", chr(c))
    return plain if len(plain) == 1 and plain < "\x7f" and (plain.isalnum() or plain in "@.+-_%()") else None


# Other forms of the signs.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "＋": "+", "﹢": "+"}
INVISIBLE = "­᠎​‌‍‎‏⁠﻿"
# digits' names.
NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_OF = {name: str(k) for names in NAMES.values() for k, name in enumerate(names.split())} | {"oh": "0"}

FOLDED = {ord(k): v for k, v in {**LOOKALIKES, **SIGNS}.items()}
FOLDED |= {c: p for c in range(0x80, 0x1FBFA) if c not in FOLDED and (p := compatible(c))}
FOLDED |= {0x130: "I"}  # its small form would else be two characters
FOLDED |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x1FBFA) if unicodedata.decimal(chr(c), None) is not None and c not in FOLDED}
FOLDED |= dict.fromkeys(map(ord, INVISIBLE), "")
ODD = re.compile("[" + "".join(map(re.escape, map(chr, FOLDED))) + "]")
FAR = re.compile("[\xa0\xaa\xad\xb2\xb3\xb9\xbaıİſ\u0149\u0180-\U0010ffff]")  # a quick look: every folded character is one of these
assert all(FAR.match(chr(c)) for c in FOLDED)

# Disguised signs, and endings of addresses. Bare words count in a whole address only, with a spelled dot
# before the ending; endings that are words of the four languages count after the names of the dot that go with them.
AT_WORDS, PLUS_WORDS = frozenset(("at", "arroba", "chez", "ät")), frozenset(("plus", "más"))
DOT_WORDS = {"dot": "de es", "punkt": "de", "punto": "es", "point": ""}
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app co uk eu fr us ca au ch nl example test invalid".split())
WORD_ENDINGS = {"de": "de", "es": "es", "it": "es"}
TOKEN = re.compile(r"\w+|\W", re.S)
ASCII_WORD = re.compile(r"[A-Za-z0-9_]+")
WORDS = re.compile(r"\w+")
BRACKETED = re.compile(rf"[\[({{<]\s?(?:{'|'.join(sorted(AT_WORDS | DOT_WORDS.keys()))}|[@.])\s?[\])}}>]", re.I)


def kinds_of(token: str) -> frozenset[str]:
    """What a token may be to the transducers: a run of word characters, or one other character."""
    found = set()
    if token in " .@-,%+":
        found.add(token)
    if token.isspace():
        found.add("space")
    if token in "[({<":
        found.add("open")
    if token in "])}>":
        found.add("close")
    low = token.lower()
    if low in DIGIT_OF:
        found.add("name")
    if low in AT_WORDS:
        found.add("at")
    if low in PLUS_WORDS:
        found.add("plus")
    if low in DOT_WORDS:
        found |= {"dot", *(f"dot {x}" for x in DOT_WORDS[low].split())}
    if "0" <= token[0] <= "9":
        found.add("digit first")
    if "0" <= token[-1] <= "9":
        found.add("digit last")
    if token.isascii() and token.isdigit():
        found.add("digits")
    if ASCII_WORD.fullmatch(token):
        letter, other = any(c.isalpha() for c in token), any(not c.isalpha() for c in token)
        found |= {"word", f"word {'o' * other}{'l' * letter}", *(("host",) if "_" not in token else ())}
        if low in ENDINGS:
            found.add("ending")
        if low in WORD_ENDINGS:
            found.add(f"ending {WORD_ENDINGS[low]}")
        if len(token) == 2 and letter and not other:
            found.add("two letters")
    return frozenset(found)


class _Kinds(dict):
    """kinds_of by token, for tokens that come again."""

    def __missing__(self, token: str) -> frozenset[str]:
        if len(self) > 200_000:
            self.clear()
        found = self[token] = kinds_of(token)
        return found


KINDS_OF = _Kinds()
COPY, DIGIT = None, "digit"


class Transducer:
    """A finite-state transducer over tokens, determinised as it meets them.

    arcs: (state, kind of token, next state, output): COPY, a text, or DIGIT for a name's digit. From the left, the
    longest run from state 0 to an accepting state is rewritten and the next begins after it; what begins no such run
    is copied. `before`: kinds that the token before a run must not have. accept: a state, and what is asked of the
    token after it: (kind, whether it must or must not have it). No run is followed further than its arcs go: all
    loops but those over one word's tokens and over spelled digits, which accept at each turn, are counted.
    """

    def __init__(self, arcs: list[tuple], accept: dict, before: frozenset[str] = frozenset()):
        self.arcs: dict = {}
        for state, kind, to, out in arcs:
            self.arcs.setdefault(state, []).append((kind, to, out))
        self.accept, self.before = accept, before
        self.first = frozenset(kind for kind, _, _ in self.arcs[0])
        self.steps: dict = {}

    def step(self, states: tuple, kinds: frozenset[str]):
        """The states after a token of some kinds, each with the state before and the output; of two ways to a state
        the one listed first."""
        back: dict = {}
        for q in states:
            for kind, to, out in self.arcs.get(q, ()):
                if kind in kinds and to not in back:
                    back[to] = (q, out)
        found = self.steps[states, kinds] = (tuple(back), back, tuple(q for q in back if q in self.accept)) if back else None
        return found

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, new) for each token that changes, in order."""
        tokens = TOKEN.findall(text)
        kinds = [KINDS_OF[t] for t in tokens]
        n = len(tokens)
        out: list[tuple[int, int, str]] = []
        places: list[int] | None = None
        k, steps, none = 0, self.steps, frozenset()
        while k < n:
            if kinds[k].isdisjoint(self.first) or (k and not kinds[k - 1].isdisjoint(self.before)):
                k += 1
                continue
            states, at, way, best = (0,), k, [], None
            while at < n:
                key = (states, kinds[at])
                got = steps[key] if key in steps else self.step(*key)
                if got is None:
                    break
                states, back, ends = got
                way.append(back)
                at += 1
                for q in ends:
                    ask = self.accept[q]
                    if ask is None or (ask[0] in (kinds[at] if at < n else none)) == ask[1]:
                        best = (at, q)
                        break
            if best is None:
                k += 1
                continue
            if places is None:
                places = [0, *accumulate(map(len, tokens))]
            at, q = best
            made = []
            for j in range(at - 1, k - 1, -1):
                q, new = way[j - k][q]
                if new is not COPY:
                    made.append((places[j], places[j + 1], DIGIT_OF[tokens[j].lower()] if new is DIGIT else new))
            out += reversed(made)
            k = at
        return out


def _brackets() -> Transducer:
    arcs = [(0, "space", 1, ""), (0, "open", 2, ""), (1, "open", 2, ""), (2, "space", 3, "")]
    for q in (2, 3):
        arcs += [(q, "at", 4, "@"), (q, "@", 4, "@"), (q, "dot", 4, "."), (q, ".", 4, ".")]
    return Transducer([*arcs, (4, "space", 5, ""), (4, "close", 6, ""), (5, "close", 6, ""), (6, "space", 7, "")], {6: None, 7: None})


def _spelled() -> Transducer:
    """Names of digits in a row, parted by one or two of blank, comma and hyphen, by a dot, or by a dot's name."""
    arcs = [(0, "name", "one", DIGIT)]
    for q in ("one", "more"):
        arcs += [(q, sign, "gap", "") for sign in " ,-"] + [(q, ".", "far", COPY), (q, " ", "blank", "")]
    arcs += [("gap", sign, "far", "") for sign in " ,-"]
    arcs += [(q, "name", "more", DIGIT) for q in ("gap", "far", "dotted")]
    return Transducer([*arcs, ("blank", "dot", "named", "."), ("named", " ", "dotted", "")], {"more": None})


def _plus() -> Transducer:
    return Transducer([(0, "plus", 1, "+"), (1, " ", 2, ""), (1, "-", 2, "")], {2: ("digit first", True)})


def _number_dots() -> Transducer:
    arcs = [(0, "digit last", 1, COPY), (3, " ", 4, ""), (4, "digits", 6, COPY), (4, "digit first", 5, COPY), (2, "dot", 3, ".")]
    return Transducer([*arcs, (1, " ", 2, ""), (6, " ", 2, "")], {5: None, 6: None})


def _addresses(names: int = 5, hosts: int = 4) -> Transducer:
    """name (dot name)* at host (dot host)* dot ending, signs spelled or not, but for the last dot, which is spelled."""
    arcs: list[tuple] = []
    sign = ("word", "%", "+", "-")
    for k in range(names):
        here, begin = ("name", k), ("begin", k) if k else 0
        arcs += [(begin, c, here, COPY) for c in sign] + [(here, c, here, COPY) for c in sign]
        arcs += [(here, " ", ("blank", k), ""), (("blank", k), "at", "at", "@"), (here, "@", "host", COPY)]
        if k + 1 < names:
            arcs += [(here, ".", ("begin", k + 1), COPY), (("blank", k), "dot", ("dot", k), "."), (("dot", k), " ", ("begin", k + 1), "")]
    arcs.append(("at", " ", "host", ""))
    for k in range(hosts):
        here, begin = ("host", k), ("next", k) if k else "host"
        arcs += [(begin, c, here, COPY) for c in ("host", "-")] + [(here, c, here, COPY) for c in ("host", "-")]
        arcs.append((here, " ", ("end", k), ""))
        for dot, ending in (("dot", "ending"), ("dot de", "ending de"), ("dot es", "ending es")):
            arcs += [(("end", k), dot, (dot, k, "."), "."), ((dot, k, "."), " ", (dot, k), ""), ((dot, k), ending, "whole", COPY)]
        if k + 1 < hosts:
            arcs += [(("dot", k), c, ("host", k + 1), COPY) for c in ("host", "-")]
    return Transducer(arcs, {"whole": ("-", False)}, frozenset(".%+-"))


def _at_domains() -> Transducer:
    """A name that no plain word would be (with a letter, and with a digit, dot or underscore), a spelled at, and a
    written domain that ends in one of the endings or any country's two letters."""
    arcs: list[tuple] = []
    signs = {"%": "", "+": "", "-": "", "word l": "l", "word o": "o", "word ol": "lo"}
    for held in ("", "l", "o", "lo"):
        for kind, more in [*signs.items(), (".", "o")]:
            to = ("name", "".join(c for c in "lo" if c in held + more))
            arcs.append((("name", held), kind, to, COPY))
            if not held and kind != ".":
                arcs.append((0, kind, to, COPY))
    arcs += [(("name", "lo"), " ", 1, ""), (1, "at", 2, "@"), (2, " ", 3, "")]
    arcs += [(q, kind, 4, COPY) for q in (3, 4, 5) for kind in ("host", "-")]
    arcs += [(4, ".", 5, COPY), (5, "ending", 6, COPY), (5, "two letters", 6, COPY), (5, "ending de", 6, COPY), (5, "ending es", 6, COPY)]
    return Transducer(arcs, {6: ("-", False)}, frozenset(".%+-"))


BRACKETS, SPELLED, PLUS, NUMBER_DOTS, ADDRESSES, AT_DOMAINS = _brackets(), _spelled(), _plus(), _number_dots(), _addresses(), _at_domains()


class Tape:
    """A text under rewriting, with each character's source span."""

    def __init__(self, text: str):
        self.text = text
        self.start = range(len(text))
        self.end = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, apart) by texts; a new character stands for its whole span."""
        if not edits:
            return
        parts, start, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            start.extend(self.start[at:a])
            end.extend(self.end[at:a])
            if b > a:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        parts.append(self.text[at:])
        start.extend(self.start[at:])
        end.extend(self.end[at:])
        self.start, self.end = start, end
        self.text = "".join(parts)


def normalise(text: str) -> Tape:
    """The deobfuscated text with source spans: the transducers one after another, each where the text has a word or
    sign that it needs."""
    tape = Tape(text)
    if FAR.search(text):
        tape.rewrite([(m.start(), m.end(), FOLDED[ord(m[0])]) for m in ODD.finditer(text)])
    if BRACKETED.search(tape.text):
        tape.rewrite(BRACKETS.edits(tape.text))
    words = set(WORDS.findall(tape.text.lower()))
    if not words.isdisjoint(DIGIT_OF):
        tape.rewrite(SPELLED.edits(tape.text))
    if not words.isdisjoint(PLUS_WORDS):
        tape.rewrite(PLUS.edits(tape.text))
    if not words.isdisjoint(DOT_WORDS):
        tape.rewrite(NUMBER_DOTS.edits(tape.text))
        if "@" in tape.text or not words.isdisjoint(AT_WORDS):
            tape.rewrite(ADDRESSES.edits(tape.text))
    if not words.isdisjoint(AT_WORDS):
        tape.rewrite(AT_DOMAINS.edits(tape.text))
    return tape


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What only the deobfuscated text shows."""
    tape = normalise(text)
    if tape.text == text:
        return []
    found = []
    for s in plain_spans(tape.text):
        a, b = tape.start[s.start], tape.end[s.end - 1]
        if text[a:b] == tape.text[s.start : s.end] or any(x.kind == s.kind and x.start < b and a < x.end for x in base):
            continue
        found.append(Span(s.kind, a, b))
    return found


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and found (all): arrays of (kind, start, end) in code points, end exclusive, for every row."""

    def make():
        def run(batch: list[str]) -> dict[str, list]:
            base = [plain_spans(x) for x in batch]
            every = [in_order(b + added_spans(x, b)) for x, b in zip(batch, base, strict=True)]
            as_rows = lambda rows: [[x._asdict() for x in row] for row in rows]
            return {"base": as_rows(base), "found": as_rows(every)}

        return run

    span = "array<struct<kind: string, start: long, end: long>>"
    return map_texts(df, [id_col], text_col, f"base {span}, found {span}", make)


def digest(found: DataFrame, id_col: str, kinds: tuple[str, ...]) -> DataFrame:
    """The columns n_<kind>, base_sha256 and spans from arrays `base` and `found`."""
    from pyspark.sql import functions as F

    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in kinds]
    return found.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")), "doc_id", KINDS)
