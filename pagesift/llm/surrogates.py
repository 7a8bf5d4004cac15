"""Surrogates for personal data: keyed, type-consistent, distinct.

Entities are found by patterns and checks of their type. Each is replaced by a value of the same
type, script and format that depends on the key and the entity's normal form alone, so the same
entity gets the same surrogate in every document and no table of entities is needed. The map is
one to one on every format: two rounds of keyed shifts, left to right and right to left, over the
alphabet of each character; where a type has a rule (check digits, octets, address class), the map
is applied again until the rule holds, which keeps it one to one. Known given names go around a
keyed cycle of names of their script and gender. A check over all entities of the corpus looks for
different entities with one surrogate; those, if any, are drawn anew.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pagesift.llm.scratch import Scratch

KEY = "surrogates"
#: entities drawn anew at most; more would mean that the map is not one to one
MAX_REDRAWN = 100_000

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Andrea Anna Anne Barbara Camille Carla Carmen Caroline Charlotte Chloe "
    "Claire Clara Claudia Elena Elisa Elizabeth Emily Emma Eva Frida Greta Hanna Helena Ines Ingrid "
    "Isabel Jane Jennifer Julia Karen Katharina Laura Lena Linda Lucia Maria Marie Martha Mary "
    "Monika Nina Olivia Patricia Paula Sabine Sandra Sarah Sofia Susan Teresa Ursula".split(),
    ("latin", "m"): "Alexander Andreas Anthony Antoine Antonio Bernd Brian Carlos Charles Christian Daniel "
    "David Diego Edward Felix Fernando Francisco Frank Friedrich George Georg Hans Henri Henry "
    "Hugo Jack James Jean John Jonas Jorge Jose Juan Karl Klaus Lucas Louis Luis Manuel Martin "
    "Matthew Michael Miguel Pablo Paul Pedro Peter Pierre Rafael Richard Robert Stefan Thomas "
    "Walter William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Галина Елена Ирина Марина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай "
    "Олег Павел Сергей".split(),
}
# Words before a name. They stay, so the family name keeps their gender.
TITLES = (
    "Mrs Ms Miss Madam Frau Mme Madame Mlle Señora Sra Srta Госпожа Mr Sir Herr Monsieur Señor Sr "
    "Господин Dr Prof Professor Doctor"
).split()
_PLACE_OF_GIVEN = {
    name.lower(): (group, k) for group, names in GIVEN.items() for k, name in enumerate(names)
}
# Characters that are exchanged for one another.
_ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "àáâãäåèéêëìíîïòóôõöùúûü", "çñ", "αεηιουω",
    "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ",
)
_ALPHABET_OF = {c: (a, k) for a in _ALPHABETS for k, c in enumerate(a)}
_HEX = "0123456789abcdef"
_HEX_OF = {c: (_HEX, k) for k, c in enumerate(_HEX)}


class Entity(NamedTuple):
    start: int
    end: int
    type: str
    #: what tells the entity from others; equal for all its spellings
    normal: str


_NAME = r"[^\W\d_][^\W\d_a-zß-öø-ÿа-я]?[^\W\d_]+(?:['’-][^\W\d_]+)*"
# behind and before an @
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[^\W\d_]{2,}")
_LOCAL = re.compile(r"[\w.+%-]")
_SECRET = re.compile(
    r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*"
    r"[\"']?([\w+/.~-]{6,}=*)"
)
_LONG_HEX = re.compile(r"(?<![\w])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w])")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NUMBER = re.compile(r"[+(]?\d[\d \u00a0\u202f().:/-]{5,}\d")
_IPV6 = re.compile(
    r"(?<!\w)(?<![0-9A-Fa-f:]:)(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f]{0,4}"
    r"(?::[0-9A-Fa-f]{0,4}){0,7}(?!\w)(?!\.\d)"
)
_IPV4 = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.*\d)")
_CARD = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!-*\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-*\d)")
_PHONE = re.compile(
    r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,4}"
    r"|\(\d{2,4}\)[ .-]?\d{2,5}(?:[ ./-]\d{2,5}){1,3}"
    r"|(?<![\d.-])\d{2,4}(?:[.-]\d{2,5}){2,4})(?!-*\d)"
)
# national numbers: pairs behind 0, a trunk code behind 0, the international prefix 00, and three,
# three and four digits of North America; the digits of a match are counted
_BLANK = "[ \u00a0\u202f]"
_GAP = f"(?:{_BLANK}?[./-]{_BLANK}?|{_BLANK})"
_NATIONAL = re.compile(
    rf"(?<![\d.,-])(?!\d{{1,2}}([ ./-])\d{{1,2}}\1(?:19|20)\d\d(?!\d))(?:"
    rf"0[1-9](?:{_GAP}?\d\d){{4}}"
    rf"|00{_BLANK}?[1-9](?:[ \u00a0\u202f()./-]{{0,3}}\d){{6,12}}"
    rf"|(?:\(0[1-9]\d{{0,4}}\){_GAP}?|0[1-9]\d{{1,4}}{_GAP})\d{{2,8}}(?:{_GAP}\d{{1,6}}){{0,4}}"
    rf"|0[1-9]\d{{8,9}}"
    rf"|(?:1{_GAP})?[2-9]\d\d{_GAP}\d{{3}}{_GAP}\d{{4}}"
    rf")(?!\d)(?!-\d)"
)
_CUED_PHONE = re.compile(rf"\(?\d(?:[ \u00a0\u202f()./-]{{0,3}}\d){{6,14}}(?!\d)")
_PHONE_CUE = re.compile(
    r"(?i)(?:\b(?:tel|phone|telephone|call|calls|called|calling|dial|ring|mobile|cell|cellphone|fax|"
    r"sms|whatsapp|hotline|telefon|telefonnummer|rufnummer|handy|handynummer|mobil|fon|anrufen|"
    r"appelez|appeler|portable|t[ée]l|t[ée]l[ée]phone|t[ée]l[ée]phonez|tel[ée]fono|m[óo]vil|celular|"
    r"llame|llamar|ll[áa]mame|тел|телефон|телефону|моб|звоните|факс)\b|\brufen? )[^\d\n]{0,25}\Z"
)
_DATE = re.compile(r"\d{4}[.-]\d{1,2}[.-]\d{1,2}|\d{1,2}[.-]\d{1,2}[.-]\d{2,4}")
_TITLED = re.compile(
    r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\b\.?[ \u00a0]+"
    rf"((?-i:{_NAME})(?:[ \u00a0](?-i:{_NAME})){{0,2}})"
)
_CUED = re.compile(
    r"(?i:\bmy name is|\bi am called|\bje m['’]appelle|\bich hei(?:ß|ss)e|\bmein name ist|\bme llamo"
    rf"|\bmi nombre es|\bменя зовут)[ \u00a0]+({_NAME}(?:[ \u00a0]{_NAME}){{0,2}})"
)
# at every word, so that the word before a given name cannot hide it
_TWO_NAMES = re.compile(
    rf"(?<![\w'’-])(?![a-zß-öø-ÿа-я])({_NAME})(?=[ \u00a0](?![a-zß-öø-ÿа-я])({_NAME}))"
)


# a lone name and what may follow it
_TOKEN = re.compile(r"(?<![\w'’-])[^\W\d_][\w'’-]*")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ipv6(shown: str) -> str:
    """The shortest spelling of an address; empty if it is none, or names only the own host."""
    try:
        found = ipaddress.IPv6Address(shown)
    except ValueError:
        return ""
    # a name between colons is no address: dead::beef
    told = any(c.isdigit() for c in shown) or shown.count(":") > 4
    return str(found) if told and int(found) > 1 else ""


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Where addresses stand. Each is read from its @ to both sides, so that a long run of word
    characters is passed once."""
    end = 0
    for at in re.finditer("@", text):
        place = at.start()
        if place <= end or text[place - 1] == "." or not _LOCAL.match(text, place - 1):
            continue
        domain = _DOMAIN.match(text, place + 1)
        if domain:
            start = place - 1
            while start > end and _LOCAL.match(text, start - 1):
                start -= 1
            end = domain.end()
            yield start, end


def find_entities(text: str) -> list[Entity]:
    """Entities in order, none overlapping; where patterns overlap, the more certain one wins."""
    found: list[Entity] = []
    starts: list[int] = []

    def add(start, end, kind, normal):
        # found is in order and without overlaps: only its neighbours can be in the way
        place = bisect_left(starts, end)
        if place == 0 or found[place - 1].end <= start:
            starts.insert(place, start)
            found.insert(place, Entity(start, end, kind, normal))

    if "@" in text:
        for start, end in _emails(text):
            add(start, end, "email", text[start:end].lower())
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            add(m.start(1), m.end(1), "secret", m[1])
    for m in _LONG_HEX.finditer(text):
        add(m.start(), m.end(), "secret", m[0])
    for m in _IBAN.finditer(text):
        normal = m[0].replace(" ", "")
        if _iban_holds(normal):
            add(m.start(), m.end(), "iban", normal)
    if text.count(":") > 1:
        for m in _IPV6.finditer(text):
            shown = m[0] if m[0].endswith("::") else m[0].rstrip(":")
            normal = _ipv6(shown)
            if normal:
                add(m.start(), m.start() + len(shown), "ip", normal)
    phones: set[int] = set()
    for part in _NUMBER.finditer(text):
        low, number = part.start(), part[0]
        for m in _IPV4.finditer(number):
            if all(int(o) < 256 for o in m[0].split(".")):
                add(low + m.start(), low + m.end(), "ip", ".".join(str(int(o)) for o in m[0].split(".")))
        for m in _CARD.finditer(number):
            add(low + m.start(), low + m.end(), "card", re.sub(r"\D", "", m[0]))
        for m in _SSN.finditer(number):
            add(low + m.start(), low + m.end(), "ssn", m[0])
        for m in _PHONE.finditer(number):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15 and not _DATE.fullmatch(m[0]):
                add(low + m.start(), low + m.end(), "phone", digits)
                phones.add(low + m.end())
        for m in _NATIONAL.finditer(number):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= (15 if digits.startswith("00") else 12):
                if not re.search(r"(?i)isbn[^\n]{0,5}\Z", text[max(0, low + m.start() - 10) : low + m.start()]):
                    add(low + m.start(), low + m.end(), "phone", digits)
                    phones.add(low + m.end())
                phones.add(low + m.end())
        for m in _CUED_PHONE.finditer(number):
            at = low + m.start()
            follows = any(at - k in phones and "\n" not in text[at - k : at] for k in range(7))
            if (follows or _PHONE_CUE.search(text, max(0, at - 45), at)) and not _DATE.match(m[0]):
                add(at, low + m.end(), "phone", re.sub(r"\D", "", m[0]))
                phones.add(low + m.end())
    for m in _TITLED.finditer(text):
        _add_names(add, text, m.start(2), m.end(2), True)
    for m in _CUED.finditer(text):
        _add_names(add, text, m.start(1), m.end(1), False)
    for m in _TWO_NAMES.finditer(text):
        if m[1].lower() in _PLACE_OF_GIVEN and m[1][0].isupper() and m[2][0].isupper():
            _add_names(add, text, m.start(), m.end(2), False)
    # the same names where they stand alone
    names = {text[e.start : e.end]: e for e in found if e.type.startswith(("given", "family"))}
    if names:
        sizes = sorted({len(n) for n in names}, reverse=True)
        for m in _TOKEN.finditer(text):
            token = m[0]
            for size in sizes:
                # a name ends with its token, or before an apostrophe in it
                if size > len(token) or (size < len(token) and token[size] not in "'’"):
                    continue
                known = names.get(token[:size])
                if known:
                    add(m.start(), m.start() + size, known.type, known.normal)
                    break
    return found


def _add_names(add, text: str, start: int, end: int, titled: bool) -> None:
    """Each capitalised word from `start`: known given names first, then family names."""
    for n, m in enumerate(re.finditer(r"[^ \u00a0]+", text[start:end])):
        word = m[0]
        if not word[0].isupper():
            break
        place = _PLACE_OF_GIVEN.get(word.lower())
        kind = f"given-{place[0][1]}" if place and (n == 0 or not titled) else "family"
        add(start + m.start(), start + m.end(), kind, word.lower())


class Surrogates:
    """The keyed map. `redrawn` counts further applications for entities that collided."""

    def __init__(self, key: str, redrawn: dict[int, int] | None = None):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.redrawn = redrawn or {}
        self.of = lru_cache(100_000)(self._of)
        self.cycle = cache(self._cycle)

    def state(self, *parts):
        text = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return hashlib.blake2b(text, key=self.key, digest_size=8)

    def number(self, *parts) -> int:
        return int.from_bytes(self.state(*parts).digest(), "big")

    def mark(self, kind: str, normal: str) -> int:
        """A keyed 63-bit name of an entity that does not tell its value."""
        return self.number("mark", kind, normal) >> 1

    def shift(self, kind: str, text: str, fixed: int = 0, alphabet=_ALPHABET_OF) -> str:
        """One application of the one-to-one map; the first `fixed` characters stay."""
        chars = list(text)
        places = [k for k in range(fixed, len(chars)) if chars[k] in alphabet]
        frame = "".join(c if c not in alphabet else alphabet[c][0][0] for c in chars)
        for turn, order in enumerate((places, places[::-1])):
            # a step follows from the frame and all characters that this turn has set so far
            state = self.state(kind, turn, frame, text[:fixed])
            for k in order:
                letters, place = alphabet[chars[k]]
                step = int.from_bytes(state.copy().digest(), "big")
                chars[k] = letters[(place + step) % len(letters)]
                state.update(chars[k].encode())
        return "".join(chars)

    def until(self, kind: str, text: str, holds, **options) -> str:
        found = self.shift(kind, text, **options)
        while not holds(found):
            found = self.shift(kind, found, **options)
        return found

    def _cycle(self, group: tuple[str, str]) -> dict[str, str]:
        names = sorted(GIVEN[group], key=lambda name: self.number("cycle", name))
        return {a.lower(): b.lower() for a, b in zip(names, names[1:] + names[:1])}

    def _of(self, kind: str, normal: str) -> str:
        found = self._once(kind, normal)
        for _ in range(self.redrawn.get(self.mark(kind, normal), 0)):
            found = self._once(kind, found)
        return found

    def _once(self, kind: str, normal: str) -> str:
        if kind.startswith("given"):
            return self.cycle(_PLACE_OF_GIVEN[normal][0])[normal]
        if kind == "family":
            # the ending tells gender in many languages and stays
            body, ending = (normal[:-1], normal[-1]) if len(normal) > 2 else (normal, "")
            return self.until(
                kind, body, lambda t: t + ending not in _PLACE_OF_GIVEN
            ) + ending if normal not in _PLACE_OF_GIVEN else self.shift("family-given", normal)
        if kind == "email":
            local, _, domain = normal.partition("@")
            labels, dot, top = domain.rpartition(".")
            return self.shift(kind, local) + "@" + self.shift("domain", labels) + dot + top
        if kind == "ip" and ":" in normal:
            # the first group tells the class of the address and stays
            first = len(normal.partition(":")[0])
            return self.until(
                "ip6", normal, lambda t: _ipv6(t) == t, fixed=first, alphabet=_HEX_OF
            )
        if kind == "ip":
            return self._address(normal)
        if kind == "card":
            return self.until(kind, normal, lambda t: _luhn(t) == _luhn(normal), fixed=1)
        if kind == "iban":
            upper = self.until(
                kind, normal.lower(), lambda t: _iban_holds(t.upper()), fixed=2
            )
            return upper.upper()
        if kind == "ssn":
            return self.shift(kind, normal)
        if kind == "phone":
            return self.shift(kind, normal, fixed=min(2, len(normal) - 6))
        alphabet = _HEX_OF if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", normal) else _ALPHABET_OF
        moved = self.shift(kind, normal.lower(), alphabet=alphabet)
        return "".join(b.upper() if a.isupper() else b for a, b in zip(normal, moved))

    def _address(self, normal: str) -> str:
        private = _private(normal)
        found = normal
        while True:
            octets = list(map(int, found.split(".")))
            for turn, order in enumerate((range(4), range(3, -1, -1))):
                done = ""
                for k in order:
                    octets[k] = (octets[k] + self.number("ip", turn, k, done)) % 256
                    done += f".{octets[k]}"
            found = ".".join(map(str, octets))
            if _private(found) == private:
                return found

    def write(self, entity: Entity, text: str) -> str:
        """The surrogate in the spelling of the entity: its separators and capitals."""
        shown, new = text[entity.start : entity.end], self.of(entity.type, entity.normal)
        if entity.type in ("card", "phone"):
            digits = iter(new)
            return "".join(next(digits) if c.isdigit() else c for c in shown)
        if entity.type == "iban":
            signs = iter(new)
            return "".join(c if c == " " else next(signs) for c in shown)
        if entity.type.startswith(("given", "family")):
            if shown.isupper() and len(shown) > 1:
                return new.upper()
            if entity.type == "family" and len(shown) == len(new):
                return "".join(b.upper() if a.isupper() else b for a, b in zip(shown, new))
            return new[:1].upper() + new[1:]
        if entity.type == "ip" and ":" in new:
            if len(shown) == 39:
                new = ipaddress.IPv6Address(new).exploded
            return new.upper() if shown.isupper() else new
        if entity.type == "email":
            return new.upper() if shown.isupper() else new
        return new


def _private(address: str) -> int:
    a, b, *_ = map(int, address.split("."))
    if a == 10:
        return 1
    if a == 172 and 16 <= b < 32:
        return 2
    if a == 192 and b == 168:
        return 3
    return 4 if a == 127 else 5 if a in (0, 255) else 0


_ENTITY = ArrayType(
    StructType(
        [
            StructField("type", StringType()),
            StructField("start", LongType()),
            StructField("mark", LongType()),
            StructField("surrogate", StringType()),
        ]
    )
)
_ENTITY_ARROW = pa.list_(
    pa.struct(
        [
            ("type", pa.string()), ("start", pa.int64()), ("mark", pa.int64()),
            ("surrogate", pa.string()),
        ]
    )
)


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[dict]]:
    parts, done, entities, length = [], 0, [], 0
    for entity in find_entities(text):
        new = surrogates.write(entity, text)
        parts += [text[done : entity.start], new]
        length += entity.start - done
        entities.append(
            {
                "type": entity.type, "start": length,
                "mark": surrogates.mark(entity.type, entity.normal),
                "surrogate": surrogates.of(entity.type, entity.normal),
            }
        )
        length += len(new)
        done = entity.end
    return "".join(parts) + text[done:], entities


def _replacer(key: str, redrawn: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key, redrawn)
        for batch in batches:
            texts, entities = [], []
            for text in batch.column(0):
                text = text.as_py()
                new, own = replace(text, surrogates) if text else (text, [])
                texts.append(new)
                entities.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(texts, pa.string()),
                    pa.array(entities, _ENTITY_ARROW),
                ],
                [*batch.schema.names[1:], "text", "entities"],
            )

    return run


def collisions(replaced: DataFrame) -> DataFrame:
    """(type, surrogate, first mark, mark) of entities that share another one's surrogate."""
    drawn = replaced.select(F.explode("entities").alias("e")).select("e.type", "e.surrogate", "e.mark")
    shared = (
        drawn.groupBy("type", "surrogate")
        .agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
        .filter("first <> last")
    )
    return (
        drawn.join(shared, ["type", "surrogate"])
        .filter("mark <> first")
        .select("type", "surrogate", "first", "mark")
        .distinct()
    )


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, entities) per row of `docs` (doc_id, text).

    text has its entities replaced; entities lists type, place in the new text, a keyed name of
    the original and the surrogate's normal form. Null texts stay null and empty ones empty, with
    no entities. The key should be a secret; equal keys give equal surrogates in every run.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    kind = StructType(
        [docs.schema["doc_id"], StructField("text", StringType()), StructField("entities", _ENTITY)]
    )
    redrawn: dict[int, int] = {}
    while True:
        replaced = scratch.store(
            docs.select("text", "doc_id").mapInArrow(_replacer(key, redrawn), kind), "replaced"
        )
        bad = collisions(replaced).limit(MAX_REDRAWN + 1).collect()
        if not bad:
            break
        if len(bad) > MAX_REDRAWN:
            raise RuntimeError("surrogates collide: the map is not one to one")
        scratch.drop(replaced)
        for row in bad:
            redrawn[row["mark"]] = redrawn.get(row["mark"], 0) + 1
    scratch.close(replaced)
    return replaced.select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities"
    )
