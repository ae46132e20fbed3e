"""Personal data and secrets replaced by keyed surrogates (operator 7).

Every kind of entity has a permutation of its own, keyed and without fixed points, over the strings of
the entity's format: letters stay letters of their script and case, vowels vowels, digits digits; a card
number or an IBAN that passes its check sum gets one that does; a first name gets one of its gender and
script; the prefix that tells a key's type stays. So equal entities have equal surrogates wherever they
stand, however they are spelt in upper or lower case, and different ones different surrogates. That is
checked over the whole corpus before any text is returned: where two entities' surrogates meet, or one
is another entity of the corpus, it is drawn anew with the next key.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, settle, slices, texts

#: FIXED VALUES: first names by gender and script, and titles by gender.
NAMES = {
    ("f", "latin"): "Anna Maria Emma Laura Julia Sarah Lisa Sophie Claire Marie Elena Carmen Isabel Lucia Alice Charlotte Emily Olivia Mary Patricia Linda Barbara Susan Jessica Karen Nancy Margaret Ingrid Katrin Brigitte".split(),
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Peter Paul Hans Klaus Stefan Jean Pierre Michel Luc Carlos Juan Luis Miguel Pedro Daniel Mark George Henry Jack Oliver".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ειρήνη Άννα".split(),
    ("m", "greek"): "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Παναγιώτης Βασίλης Χρήστος Αθανάσιος Μιχάλης".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Dr": "", "Prof": ""}
TITLES |= {t: g for k, g in {"господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f", "доктор": "", "профессор": "", "κύριος": "m", "κυρία": "f", "κύριε": "m"}.items() for t in (k, k.capitalize())}
#: FIXED VALUES: words that aren't taken for a name behind a first name, or where they recur without a title.
NO_NAMES = frozenset("A An And Are As At But By For From Had Has Have He Her His How I If In Is It Its My No Not Of On Or Our She So That The Their They This To Was We Were What When Where Who Why Will With You Your И В Во На Он Она Они Мы Вы Я Но Не По С К А Και Ο Η Το Οι Τα Δεν Να Με Σε Για".split())
_GENDER = {n.lower(): k for k, names in NAMES.items() for n in names}

#: FIXED VALUES: alphabets that a character is replaced within.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çðñþß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_HEX = "0123456789abcdef"

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞΆΈ-ΊΌΎΏΑ-ΡΣ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
WORD = rf"[{_UPPER}][{_LOWER}]+"
#: Prefixes that tell what a key opens, and words that a secret is assigned to.
KEY_PREFIXES = r"AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox[abprs]-|AIza|eyJ"
SECRET_WORDS = r"token|secret|passwd|password|pwd|passphrase|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
_ASSIGNED = rf"(?ai:(?:{SECRET_WORDS})[A-Za-z0-9_-]{{0,24}}[\"']?[ \t]{{0,4}}(?::=|=>|[=:])[ \t]{{0,4}})(?:[\"'](?P<quoted>[^\s\"']{{6,}})(?=[\"'])|(?P<bare>(?=[^\s\"']*[0-9])(?=[^\s\"']*[A-Za-z])[A-Za-z0-9_+/=.~-]{{7,}}[A-Za-z0-9_+/=~-]))"
#: What is looked for, the first that matches at a place. The part of an address before its @ has 64 characters at most.
PATTERNS = (
    ("email", r"[^\W_][\w.+-]{0,63}@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+"),
    ("secret", rf"{_ASSIGNED}|(?<![0-9A-Za-z])(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})(?![0-9A-Za-z])|\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b|\bgh[pousr]_[A-Za-z0-9]{{36}}\b|\bglpat-[\w-]{{20}}|\bsk-[A-Za-z0-9_-]{{20,}}|\bxox[abprs]-[A-Za-z0-9-]{{10,}}|\bAIza[\w-]{{35}}|\beyJ[\w-]{{8,}}\.[\w-]{{8,}}\.[\w-]{{4,}}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])|(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])(?=\+(?:[ .()-]{0,2}[0-9]){8})\+(?!1[^0-9])[0-9]{1,3}(?P<gap>[ .-])(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:(?P=gap)?[0-9]{1,4}){1,7}(?![0-9])|(?<![0-9+])\+(?!1[^0-9])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9.])[0-9]{13,19}(?![0-9.][0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
)
#: A word that a capitalised one follows: a title or a first name, perhaps; and the words behind it.
_BEFORE_NAME = re.compile(rf"(?<!\w)([^\W\d_]+(?:-[^\W\d_]+)?)(\.?)(?= [{_UPPER}][{_LOWER}])")
_NAME = re.compile(rf" ({WORD})(?: ({WORD}))?")
_ALONE = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")


_KINDS = {k: 1 << i for i, (k, _) in enumerate(PATTERNS)}
_SPELT = [w.encode() for word in SECRET_WORDS.split("|") for w in ([word] if "[" not in word else [word.replace("[_-]?", x) for x in ("", "_", "-")])]
_OPENERS = [w.encode() for w in re.sub(r"gh\[pousr\]_|xox\[abprs\]-", "gh|xox", KEY_PREFIXES).split("|")]
_SHAPE = bytes(57 if 48 <= c < 58 else 65 if 65 <= c < 91 else c for c in range(256))  # digits become 9, capitals A
_HEXED = bytes(104 if chr(c) in "0123456789abcdefABCDEF" else 32 for c in range(256))
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_LEADS = frozenset(w.encode() for t in (*TITLES, *(n for names in NAMES.values() for n in names)) for w in t.split("-"))
_LETTERS = re.compile(r"[^\W\d_]+")


def hints(text: str) -> tuple[int, bool]:
    """(bits of the kinds, whether names) that a text may hold: each match of a pattern holds what is asked for here."""
    raw = text.encode("utf-8", "replace")
    shape = raw.translate(_SHAPE)
    has = shape.__contains__
    kinds = _KINDS["email"] if b"@" in raw else 0
    kinds |= _KINDS["ip"] * (has(b"9.9") or b"::" in raw or raw.count(b":") > 6)
    if has(b"9"):
        kinds |= _KINDS["iban"] * has(b"AA99") | _KINDS["phone"] * (has(b"+9") or has(b"(999)") or has(b"999-999-"))
        kinds |= _KINDS["ssn"] * has(b"999-99-") | _KINDS["card"] * (has(b"9" * 13) or has(b"9999 9999") or has(b"9999-9999"))
    low = raw.lower()
    if any(w in low for w in _SPELT) or any(w in raw for w in _OPENERS) or b"h" * 32 in raw.translate(_HEXED):
        kinds |= _KINDS["secret"]
    words = set(raw.translate(_APART).split())
    names = not _LEADS.isdisjoint(words)
    if not names:
        beyond = b" ".join(w for w in words if not w.isascii()).decode()
        names = not _LEADS.isdisjoint(w.encode() for w in _LETTERS.findall(beyond))
    return kinds, names


@lru_cache(maxsize=None)
def _any(kinds: int) -> re.Pattern:
    """The patterns of some kinds."""
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS if kinds & _KINDS[k]))


# ------------------------------------------------------------------ permutations
class Permutation:
    """A keyed permutation of 0 .. n - 1 that is one single cycle: no number stays where it is."""

    ROUNDS = 8

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n, self.a = n, isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)
        self.seed = hashlib.blake2b(tweak.encode(), key=key, digest_size=32).digest()
        self.step = 1 + self._f(0, 99, n) % (n - 1) if n > 1 else 0

    def _f(self, x: int, r: int, size: int) -> int:
        raw = x.to_bytes((x.bit_length() + 7) // 8 or 1, "little")
        n = size.bit_length() // 8 + 9
        if n > 64:
            return int.from_bytes(hashlib.shake_256(self.seed + bytes([r]) + raw).digest(n), "little") % size
        return int.from_bytes(hashlib.blake2b(bytes([r]) + raw, key=self.seed, digest_size=n).digest(), "little") % size

    def _forth(self, x: int) -> int:
        a, b = self.a, self.b
        while True:
            left, right = x % a, x // a
            for r in range(0, self.ROUNDS, 2):
                left = (left + self._f(right, r, a)) % a
                right = (right + self._f(left, r + 1, b)) % b
            x = right * a + left
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        a, b = self.a, self.b
        while True:
            left, right = x % a, x // a
            for r in range(self.ROUNDS - 2, -1, -2):
                right = (right - self._f(left, r + 1, b)) % b
                left = (left - self._f(right, r, a)) % a
            x = right * a + left
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        # A shift between a permutation and its inverse; the step is coprime to n often enough, and never 0.
        return self._back((self._forth(x) + self.step) % self.n)


WIDE = 512  # characters that are permuted together


def _permuted(numbers: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A permutation of numbers below ``sizes``; of a long row piece by piece, each by a permutation that the pieces before it choose."""
    out, before = [], hashlib.blake2b(tweak.encode(), digest_size=16)
    for k in range(0, len(numbers), WIDE):
        piece, own = numbers[k : k + WIDE], sizes[k : k + WIDE]
        n, x = 1, 0
        for i, s in zip(piece, own, strict=True):
            x, n = x * s + i, n * s
        if n > 1:
            x = Permutation(n, key, f"{tweak}|{n}|{before.hexdigest()}" if k else f"{tweak}|{n}")(x)
        new = []
        for s in reversed(own):
            x, i = divmod(x, s)
            new.append(i)
        out += new[::-1]
        before.update(repr(piece).encode())
    return out


@lru_cache(maxsize=10_000)
def _alphabet(c: str) -> tuple[str, int] | None:
    """(alphabet, place) of a lower-case character: that of the fixed ones, else the like characters among its 64 neighbours in Unicode."""
    if c in _PLACE:
        return _PLACE[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(chr(zero + i) for i in range(10)), unicodedata.decimal(c)

    def alike(x: str) -> bool:
        return unicodedata.category(x) == kind and x not in _PLACE and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x and (x.upper() == x) == (c.upper() == c)

    if kind not in ("Ll", "Lo", "Lm") or not alike(c):
        return None
    first = ord(c) & ~63
    found = "".join(x for x in map(chr, range(first, first + 64)) if alike(x))
    return (found, found.index(c)) if len(found) > 1 else None


def _form(text: str, key: bytes, tweak: str, alphabet: str | None = None) -> str:
    """Replace each letter and digit within its alphabet, keeping case and all else."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    found = [(k, (alphabet, alphabet.index(c)) if alphabet and c in alphabet else _alphabet(c)) for k, c in enumerate(low)]
    found = [(k, p) for k, p in found if p]
    shape = "".join(str(ALPHABETS.index(p[0])) if p[0] in ALPHABETS else "h" if p[0] == _HEX else f"<{p[0][0]}>" for _, p in found)
    new = _permuted([p[1] for _, p in found], [len(p[0]) for _, p in found], key, f"{tweak}|{shape}")
    out, capitals = list(text), bool(alphabet) and text == text.upper()
    for (k, p), i in zip(found, new, strict=True):
        c = p[0][i]
        out[k] = c.upper() if (capitals or text[k] != low[k]) and len(c.upper()) == 1 else c
    return "".join(out)


def _luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str, key: bytes, tweak: str, right: Callable[[str], bool] | None = None) -> str:
    """Permute the digits of a text; with ``right`` among the digit strings for which it holds."""
    old = new = re.sub(r"[^0-9]", "", text)
    while True:
        new = "".join(map(str, _permuted([int(d) for d in new], [10] * len(new), key, f"{tweak}|{len(old)}")))
        if right is None or right(new):
            break
    supply = iter(new)
    return re.sub(r"[0-9]", lambda m: next(supply), text)


def _iban(text: str, key: bytes) -> str:
    def rest(t: str) -> int:
        return int("".join(str(int(c, 36)) for c in t)) % 97

    def valid(t: str) -> bool:
        flat = t.replace(" ", "")
        return 2 <= int(flat[2:4]) <= 98 and rest(flat[4:] + flat[:4]) == 1

    country = text[:2]
    if valid(text):
        account = _form(text[4:], key, f"iban{country}")
        return f"{country}{98 - rest(account.replace(' ', '') + country + '00'):02d}{account}"
    new = text
    while True:  # to the next that fails its check sum too
        new = country + _form(new[2:], key, f"iban{country}no")
        if not valid(new):
            return new


def _ipv6(text: str, key: bytes) -> str:
    """Groups that aren't zero are permuted together; the spelling stays short or long."""
    groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
    some = [k for k, g in enumerate(groups) if g]
    for k, g in zip(some, _permuted([groups[k] - 1 for k in some], [65535] * len(some), key, f"ipv6{some}"), strict=True):
        groups[k] = g + 1
    new = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups))
    out = new.exploded if len(text) == 39 else new.compressed if "::" in text else ":".join(f"{g:x}" for g in groups)
    return out.upper() if text == text.upper() != text.lower() else out


#: Roles of a name's words: a first name of the lists, another first name by the title's gender, a last name.
LISTED, LAST = "listed", "last"


def _roles(name: str) -> list[tuple[str, str]]:
    """(word, role) of the words behind a name's title, or of a name that begins with a first name."""
    head, *words = name.split(" ")
    title = head.rstrip(".")
    gender = TITLES.get(title, "")
    if title not in TITLES:
        words = [head, *words]
    return [(w, LISTED if k == 0 and w.lower() in _GENDER else f"first{gender}" if k == 0 and len(words) > 1 else LAST) for k, w in enumerate(words)]


def _word(word: str, role: str, key: bytes) -> str:
    """The replacement of a word of a name in its role. First names of the lists map to such, others to others."""
    if role == LISTED:
        names = sorted(NAMES[_GENDER[word.lower()]], key=lambda n: hashlib.blake2b(n.encode(), key=key, digest_size=16).digest())
        return names[([n.lower() for n in names].index(word.lower()) + 1) % len(names)]
    new = word
    while True:
        new = _form(new, key, role)
        if role == LAST or new.lower() not in _GENDER:
            return new


def _sort(secret: str) -> tuple[str, bool]:
    """What a secret has in common with its surrogate: (its prefix, whether it is hexadecimal)."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", secret):
        return "", True
    return re.match(rf"(?:{KEY_PREFIXES})?", secret)[0], False


def surrogate(kind: str, text: str, key: bytes, redrawn: Redrawn | None = None) -> str:
    """The replacement of one entity, by the key, or by a later one where ``redrawn`` says so.

    Under one key entities of a kind never share a surrogate: what tells their formats apart stays.
    """
    if kind == "name":
        words = " ".join(surrogate(f"name, {role}", w, key, redrawn) for w, role in _roles(text))
        head = text.split(" ")[0]
        return f"{head} {words}" if head.rstrip(".") in TITLES else words
    if redrawn and _roomy(kind, text):
        key = next_key(key, redrawn.turn(_digest(kind, text)))
    return _drawn(kind, text, key)


@lru_cache(maxsize=50_000)
def _drawn(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity, or of a word of a name, by this very key."""
    if kind.startswith("name, "):
        return _word(text, kind[6:], key)
    if kind == "ip":
        return _ipv6(text, key) if ":" in text else ".".join(map(str, _permuted([int(x) for x in text.split(".")], [256] * 4, key, "ip")))
    if kind == "card":
        valid = _luhn(re.sub(r"[^0-9]", "", text))
        return _digits(text, key, f"card{valid}", lambda d: _luhn(d) == valid)
    if kind == "phone" and text.startswith("+"):
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text)[0]
        return country + _digits(text[len(country) :], key, f"phone{country}")
    if kind in ("phone", "ssn"):
        return _digits(text, key, kind)
    if kind == "iban":
        return _iban(text, key)
    if kind == "secret":
        prefix, hexed = own = _sort(text)
        if hexed:
            return _form(text, key, "hex", _HEX)
        new = text
        while True:  # to the next of its sort
            new = prefix + _form(new[len(prefix) :], key, f"secret{prefix}")
            if _sort(new) == own:
                return new
    name, _, domain = text.rpartition("@")
    labels = domain.split(".")
    shown = name + "@" + ".".join(labels[:-1])
    return _form(shown, key, "email." + labels[-1].lower()) + "." + labels[-1]


def _same(kind: str, text: str) -> str:
    """The spelling under which mentions of one entity are the same."""
    if kind == "ip" and ":" in text:
        return ipaddress.IPv6Address(text).exploded
    return text.lower() if kind in ("email", "secret") else re.sub(r"[^0-9]", "", text) if kind in ("card", "ssn") else text


def _digest(kind: str, text: str) -> str:
    return hashlib.blake2b(f"{kind}|{_same(kind, text)}".encode(), digest_size=16).hexdigest()


def next_key(key: bytes, turn: int) -> bytes:
    """The key itself, or the one that follows it after some turns."""
    return key if not turn else hashlib.blake2b(turn.to_bytes(4, "little"), key=key[:64], digest_size=32).digest()


# ------------------------------------------------------------------ texts
def _found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of what the patterns and names find, in order, none over another."""
    kinds, names = hints(text)
    spans = []
    for m in _any(kinds).finditer(text) if kinds else ():
        kind, (start, end) = m.lastgroup, m.span()
        if kind == "secret":
            start, end = next((m.span(g) for g in ("quoted", "bare") if m[g]), (start, end))
        if kind == "ip" and ":" in m[0]:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
        spans.append((start, end, kind, text[start:end]))
    for m in _BEFORE_NAME.finditer(text) if names else ():
        titled = m[1] in TITLES
        if titled or not m[2] and m[1].lower() in _GENDER and m[1][0].isupper():
            name = _NAME.match(text, m.end())
            if name and (titled or name[1] not in NO_NAMES):
                end = name.end() if titled else name.end(1)
                spans.append((m.start(), end, "name", text[m.start() : end]))
    spans.sort(key=lambda s: (s[0], s[2] == "name"))
    out: list[tuple[int, int, str, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _mentions(text: str | None) -> list[tuple[int, int, str, str, tuple[tuple[str, str], ...]]]:
    """(start, end, kind, entity, words) of all that is replaced: ``words`` (with roles) of a name's words that recur alone."""
    if not text:
        return []
    found = [(*s, ()) for s in _found(text)]
    roles: dict[str, tuple[str, str]] = {}
    for _, _, kind, entity, _ in found:
        if kind == "name":
            for word, role in _roles(entity):
                if word not in NO_NAMES:
                    roles.setdefault(word, (word, role))
                    roles.setdefault(word.upper(), (word, role))
    if roles:
        runs: list[list[int]] = []
        for m in _ALONE.finditer(text):
            if m[0] in roles:
                if runs and m.start() == runs[-1][1] + 1 and text[runs[-1][1]] == " ":
                    runs[-1][1] = m.end()
                else:
                    runs.append([m.start(), m.end()])
        taken = iter([*found, (len(text), len(text))])
        entity, more = next(taken), []
        for start, end in runs:
            while entity[1] <= start < len(text):
                entity = next(taken)
            if end <= entity[0]:
                more.append((start, end, "name", text[start:end], tuple(roles[w] for w in text[start:end].split(" "))))
        found = sorted(found + more)
    return found


def replace(text: str | None, key: bytes, redrawn: Redrawn | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """A text without its entities, and (kind, entity, surrogate) of each.

    The words of a name with a title or a known first name are replaced wherever they recur in the text,
    alone or together. A match without any letter or digit (a masked password) is no entity.
    """
    out, found, at = [], [], 0
    for start, end, kind, entity, words in _mentions(text):
        if words:
            parts = [surrogate(f"name, {role}", w, key, redrawn) for w, role in words]
            new = " ".join(p if shown == w else p.upper() for p, (w, _), shown in zip(parts, words, entity.split(" "), strict=True))
        else:
            new = surrogate(kind, entity, key, redrawn)
        if new != entity:
            out += (text[at:start], new)
            found.append((kind, entity, new))
            at = end
    return ("".join([*out, text[at:]]) if found else text), found


# ------------------------------------------------------------------ the check of the whole corpus
def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entity) of each batch, once; of names their words in their roles."""
    for batch in batches:
        seen: set[tuple[str, str]] = set()
        for text in batch.column(0):
            for _, _, kind, entity, words in _mentions(text.as_py()):
                if kind != "name":
                    seen.add((kind, entity))
                else:
                    seen.update((f"name, {role}", w) for w, role in words or _roles(entity))
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["kind", "entity"])


ROOMY = 6.0  # a format of more than 10 ** ROOMY strings has room for surrogates that are no entity


@lru_cache(maxsize=50_000)
def _roomy(kind: str, text: str) -> bool:
    if kind == "secret" and _sort(text)[1]:
        return len(text) * log10(len(_HEX)) > ROOMY
    return kind == "ip" or kind != f"name, {LISTED}" and sum(log10(len(a[0])) for a in map(_alphabet, text.lower()) if a) > ROOMY


SPOT, MARK_BITS, SPARSE = 28, 28, 64  # bits of a spot; of the most marks of the first level; places for each mark


class Redrawn:
    """How many keys further surrogates are drawn: a level of marks for each key that is passed over.

    An entity hashes to a place of each level, and is drawn by the key of the first level that has no mark
    there. Few other entities share a marked place; those go on to the next key with it. So the levels say it
    of any number of entities in 64 MB at most: 2 ** 28 places in the first level, half of the last in each
    further one.
    """

    def __init__(self, levels: tuple[tuple[int, np.ndarray], ...] = ()):
        self.levels = levels  # (bits of a place, marks as 64-bit words)

    def __bool__(self) -> bool:
        return bool(self.levels)

    @staticmethod
    def spot(digest: str, turn: int) -> int:
        odd = 0x9E3779B97F4A7C15F39CC0605CEDC835 * (2 * turn + 1)
        return int(digest, 16) * odd % (1 << 128) >> (128 - SPOT)

    def turn(self, digest: str) -> int:
        for turn, (bits, marks) in enumerate(self.levels):
            place = self.spot(digest, turn) >> (SPOT - bits)
            if not int(marks[place >> 6]) >> (place & 63) & 1:
                return turn
        return len(self.levels)

    def marked(self, bad: DataFrame) -> Redrawn:
        """With marks for the entities (turn, spot) of ``bad`` as well."""
        counts = sorted(tuple(r) for r in bad.groupBy("turn").agg(F.count(F.lit(1))).collect())
        levels = list(self.levels)
        for turn, n in counts:
            most = max(10, MARK_BITS - turn)
            bits, marks = levels[turn] if turn < len(levels) else (min(most, max(10, (SPARSE * n - 1).bit_length())), None)
            marks = np.zeros(1 << bits - 6, np.uint64) if marks is None else marks.copy()
            place = F.shiftright("spot", SPOT - bits)
            new = bad.where(F.col("turn") == turn).select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")).toArrow()
            marks[new.column("word").to_numpy()] |= new.column("bits").to_numpy().view(np.uint64)
            levels[turn : turn + 1] = [(bits, marks)]
        return Redrawn(tuple(levels)) if counts else self


def _draw(key: bytes, redrawn):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, entity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = surrogate(kind, entity, key, redrawn.value)
                if new != entity:
                    of, roomy = _digest(kind, entity), _roomy(kind, entity)
                    turn = redrawn.value.turn(of) if roomy else 0
                    rows.append((kind, of, _digest(kind, new), roomy, turn, Redrawn.spot(of, turn)))
            types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "of", "is", "roomy", "turn", "spot"])

    return draw


TURNS = 16


def redraw(docs: DataFrame, key: bytes, text_col: str = "text") -> Redrawn:
    """How many keys further the corpus's surrogates are drawn, that they meet neither each other nor an entity.

    Drawn anew is a surrogate that another entity has too, and one that is itself another entity of
    its kind in the corpus; both where the format has more than a million strings (first names map onto their
    list, and a corpus may hold all of a short format; by one key a format's surrogates never meet). The
    corpus's distinct entities are written to the shared folder for this and deleted at the end. However many are drawn
    anew, the driver and the tasks hold no more than the marks of ``Redrawn``. Should 16 keys not
    be enough, the last state without two entities of one surrogate holds.
    """
    spark = docs.sparkSession
    entities = settle(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(_entities), "kind string, entity string").distinct(), "entities", few=True)
    redrawn, sound = Redrawn(), None
    try:
        for _ in range(TURNS):
            drawn = entities.mapInArrow(lean(_draw(key, spark.sparkContext.broadcast(redrawn))), "kind string, of string, is string, roomy boolean, turn int, spot int")
            drawn = settle(drawn.distinct(), "drawn", few=True)
            shared = drawn.groupBy("kind", "is").agg(F.min("of").alias("first"), F.max("of").alias("last")).where("first <> last").select("kind", "is", "first")
            met = drawn.join(shared, ["kind", "is"]).where("of <> first").select("roomy", "turn", "spot", F.lit(True).alias("met"))
            taken = drawn.where("roomy").join(drawn.select("kind", F.col("of").alias("is")).distinct(), ["kind", "is"], "left_semi").select("roomy", "turn", "spot", F.lit(False).alias("met"))
            bad = settle(met.union(taken).groupBy("roomy", "turn", "spot").agg(F.max("met").alias("met")), "bad", few=True)
            sound = redrawn if bad.where("met").isEmpty() else sound
            redrawn, last = redrawn.marked(bad.where("roomy").select("turn", "spot")), redrawn
            for table in (drawn, bad):
                forget(table)
            if redrawn is last:
                break
    finally:
        forget(entities)
    if sound is None:
        raise RuntimeError(f"{TURNS} keys leave entities with the surrogate of another")
    return sound


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", checked: bool = True) -> DataFrame:
    """All columns of docs with the text's entities replaced, and n_entities and entity_kinds added.

    Kinds: email, secret, ip, iban, phone, ssn, card, name (with a title or a known first name, and its words wherever they
    recur in that text, capitalised or in capitals). All else in a text stays as it
    is, and so does what has no letter or digit to replace, such as a masked password. Null text stays
    null, without entities; an empty one stays empty; texts of any length are read whole; an empty table
    gives no rows. Repeated rows get equal results; columns of the input that
    have the names of the new ones are replaced. One pass without a shuffle, behind the check of
    ``redraw`` (left out with ``checked=False``).
    """
    new = ("n_entities", "entity_kinds")
    kept = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    place = kept.index(text_col)
    redrawn = docs.sparkSession.sparkContext.broadcast(redraw(docs, key, text_col) if checked else Redrawn())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = texts(whole.column(place))
            for i, j in slices(offsets, 4 << 20):
                batch = whole.slice(i, j - i)
                done = [replace(t, key, redrawn.value) for t in batch.column(place).to_pylist()]
                columns = list(batch.columns)
                columns[place] = pa.array([t for t, _ in done], pa.string())
                kinds = [",".join(sorted({f[0] for f in found})) for _, found in done]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(f) for _, f in done], pa.int64()), pa.array(kinds, pa.string())], names=[*kept, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n_entities long, entity_kinds string"])
    return rows.mapInArrow(lean(run), schema)
