"""Personal data replaced by keyed surrogates.

A surrogate comes from a keyed permutation of all values of the entity's kind and format, so equal entities get
equal surrogates in every document and different ones different surrogates, with no table of assignments to
keep or to shuffle. The permutation is a Feistel network q taken as q^-1(q(x) + s): it has no fixed point.
Values that a kind rules out (private address ranges, listed given names) are walked over, which keeps it a
permutation of the rest. Names keep gender, script, capitals and their pattern of vowels and consonants; numbers
keep separators, length and check digits. Long values are permuted in blocks, each under a key of all before it.

Names are found by what stands around them: a title or a listed given name, a phrase by which people introduce
themselves or sign, an address in angle brackets after them; capitals in Latin, Cyrillic or Greek letters. What is
found once in a text is replaced wherever it stands in it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import texts

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Sarah Emma Sophie Claudia Elena Marta Lucia Carmen Isabel Claire Camille Marie Louise Alice Helen Mary Patricia Linda Barbara Elizabeth Jennifer Susan Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Ingrid Ursula Monika Petra Sabine".split(),
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Hans Klaus Jürgen Stefan Wolfgang Dieter Pierre Jean Louis Michel Antoine Henri Jacques Carlos José Juan Miguel Antonio Luis Pedro Javier Manuel".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
}
TITLES = {"m": "Mr Herr Señor Sr Monsieur Sir".split(), "f": "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Mlle Lady".split(), "": "Dr Prof Doctor Professor".split()}
# Phrases before a name, in English, German, French, Spanish and Russian.
BEFORE = (
    "my name is", "my name's", "signed by", "sincerely,", "regards,", "mein name ist", "ich heiße", "mit freundlichen grüßen", "je m'appelle", "je m’appelle", "mon nom est",
    "cordialement,", "me llamo", "mi nombre es", "atentamente,", "меня зовут", "с уважением,", "full name:", "first name:", "last name:", "contact person:", "patient:", "nombre:", "vorname:", "nachname:",
)
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789")
_PLACE = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}
_KNOWN = {n.lower(): (gender, script) for (gender, script), names in GIVEN.items() for n in names}

_CAP = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][^\W\d_]+(?:['’-][^\W\d_]+)*"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ (.-])[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?!\w)",
    "card": r"(?<![\w.+-])[3-6][0-9]{3}[ -]?(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|[0-9]{6}[ -]?[0-9]{5})(?![\w-])",
    "person": rf"\b(?:(?:{_TITLE})\.? (?:{_CAP})(?: (?!(?:{_TITLE})\b){_CAP})?|(?:{'|'.join(n for ns in GIVEN.values() for n in ns)}) {_CAP})",
    # what is in front takes any capitals; the name itself is the group
    "introduced": rf"\b(?i:{'|'.join(map(re.escape, BEFORE))})\s+(?P<name>{_CAP}(?:[ \t]{_CAP}){{0,2}})",
    "addressed": rf"(?<!\w)(?P<name>{_CAP}(?:[ \t]{_CAP}){{1,2}})(?=[ \t]?<[\w.+%-]+@)",
}
_NUMERIC = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in ("ip", "ssn", "phone", "card")))
_EMAIL, _IBAN, _PERSON, _INTRODUCED, _ADDRESSED = (re.compile(PATTERNS[k]) for k in ("email", "iban", "person", "introduced", "addressed"))
_PHRASE = re.compile("|".join(sorted({re.escape(b.split()[-1].rstrip(":,")) for b in BEFORE})), re.IGNORECASE)
#: Cheap scans of every text; the patterns above run only where one of these finds something.
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}[0-9]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ]\w+")
_CUES = {t for ts in TITLES.values() for t in ts} | {n for ns in GIVEN.values() for n in ns}
_NAME = re.compile(_CAP)
_TOKEN = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")
_PART = re.compile(r"[^\W\d_]+")
LONG = 64  # characters of a value that are permuted together


def luhn(digits: str) -> int:
    """Sum that a valid card number makes divisible by 10."""
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))


class Surrogates:
    """Keyed replacements; the same key gives the same ones everywhere."""

    def __init__(self, key: bytes):
        self.key = key
        self.permuted = lru_cache(1 << 16)(self._permuted)

    def _random(self, bits: int, *parts) -> int:
        plain = repr([hex(p) if isinstance(p, int) else p for p in parts])  # decimal digits take time, and Python bounds them
        h = hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=-(-bits // 8) or 1)
        return int.from_bytes(h.digest(), "little") & ((1 << bits) - 1)

    def _feistel(self, x: int, n: int, label: tuple, back: bool = False) -> int:
        """A permutation of 0..n-1: six rounds on the next even number of bits, walked into the range."""
        half = max(1, -(-(n - 1).bit_length() // 2))
        low = (1 << half) - 1
        while True:
            a, b = x >> half, x & low
            for r in reversed(range(6)) if back else range(6):
                a, b = (b ^ self._round(half, r, a, label), a) if back else (b, a ^ self._round(half, r, b, label))
            x = a << half | b
            if x < n:
                return x

    def _round(self, half: int, r: int, x: int, label: tuple) -> int:
        out, k = 0, 0
        while k * 512 < half:
            out |= self._random(min(512, half - 512 * k), label, r, x, k) << 512 * k
            k += 1
        return out

    def _permuted(self, x: int, n: int, label: tuple) -> int:
        """x's image under a permutation of 0..n-1 without fixed points (n of 2 or more)."""
        if n < 2:
            return x
        step = 1 + self._random(64, "step", label) % (n - 1)
        return self._feistel((self._feistel(x, n, label) + step) % n, n, label, back=True)

    def digits(self, s: str, *label) -> str:
        return str(self.permuted(int(s), 10 ** len(s), ("digits", len(s), *label))).zfill(len(s)) if s else s

    def letters(self, s: str, kind: str, bad: Callable[[str], bool] = lambda s: False) -> str:
        """Every character of a known alphabet becomes another of the same, others and capitals stay.

        Of more than LONG characters each block has a permutation of its own, keyed by the text before it (without
        regard to capitals), so different values still have different surrogates.
        """
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        if len(s) <= LONG:
            new = self._letters(low, (kind,), bad)
        else:
            before, parts = hashlib.blake2b(key=self.key[:64]), []
            for k in range(0, len(s), LONG):
                parts.append(self._letters(low[k : k + LONG], (kind, len(s), k, before.hexdigest())))
                before.update(low[k : k + LONG].encode("utf-8", "surrogatepass"))
            new = "".join(parts)
        return "".join(c.upper() if o != o.lower() and len(c.upper()) == 1 else c for c, o in zip(new, s))

    def _letters(self, low: str, label: tuple, bad: Callable[[str], bool] = lambda s: False) -> str:
        form = tuple(_PLACE[c][0] if c in _PLACE else c for c in low)
        n = x = None
        for c in low:
            if c in _PLACE:
                a, k = _PLACE[c]
                n, x = (n or 1) * len(a), (x or 0) * len(a) + k
        if not n:
            return low
        while True:
            x = self.permuted(x, n, (*label, form))
            rest, out = x, []
            for a in reversed(form):
                if a in ALPHABETS:
                    rest, k = divmod(rest, len(a))
                    out.append(a[k])
                else:
                    out.append(a)
            new = "".join(reversed(out))
            if not bad(new):
                return new

    def name(self, s: str) -> str:
        known = _KNOWN.get(s.lower())
        if not known:
            return self.letters(s, "name", lambda x: x in _KNOWN)
        names = GIVEN[known]
        at = next(k for k, n in enumerate(names) if n.lower() == s.lower())
        new = names[self.permuted(at, len(names), ("given", *known))]
        return new.upper() if s.isupper() else new

    def _refill(self, s: str, new: str) -> str:
        """s with its digits and letters replaced in order."""
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in s)

    def email(self, s: str) -> str:
        body, _, top = s.rpartition(".")
        return f"{self.letters(body, f'email.{top.lower()}')}.{top}"

    def phone(self, s: str) -> str:
        own = re.sub(r"\D", "", s)
        code = re.match(r"\+([0-9]{1,3})(?=[^0-9])", s)
        lead = len(code[1]) if code else (1 if s[0] == "+" else 0)
        return self._refill(s, own[:lead] + self.digits(own[lead:], "phone", own[:lead] or "1"))

    def ssn(self, s: str) -> str:
        return self._refill(s, self.digits(s.replace("-", ""), "ssn"))

    def card(self, s: str) -> str:
        own = re.sub(r"\D", "", s)
        body = own[0] + self.digits(own[1:-1], "card", own[0])
        check = (luhn(own) - luhn(body + "0")) % 10
        return self._refill(s, body + str(check))

    def ip(self, s: str) -> str:
        a = [int(p) for p in s.split(".")]
        kept = next((k for k, test in ((1, a[0] in (0, 10, 127)), (2, a[:2] in ([192, 168], [169, 254]) or a[0] == 172 and 16 <= a[1] < 32), (0, True)) if test), 0)
        x, n, label = int.from_bytes(bytes(a[kept:])), 256 ** (4 - kept), ("ip", *a[:kept])
        while True:
            x = self.permuted(x, n, label)
            out = [*a[:kept], *x.to_bytes(4 - kept)]
            odd = out[0] in (0, 10, 127) or out[:2] in ([192, 168], [169, 254]) or out[0] == 172 and 16 <= out[1] < 32
            if kept or not odd:
                return ".".join(map(str, out))

    def iban(self, s: str) -> str:
        own = s.replace(" ", "")
        rest = self.letters(own[4:], f"iban.{own[:2]}")
        value = lambda check: int("".join(str(int(c, 36)) for c in rest + own[:2] + check)) % 97
        was = int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97
        check = f"{(was - value('00')) % 97:02d}"
        return self._refill(s, own[:2] + check + rest)

    def person(self, s: str) -> str:
        titles = {t for ts in TITLES.values() for t in ts}
        return re.sub(_CAP, lambda m: m[0] if m[0] in titles else self.name(m[0]), s)

    def of(self, kind: str, s: str) -> str:
        return getattr(self, kind)(s)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    end = 0
    for run in _NUMBER.finditer(text):
        for m in _NUMERIC.finditer(text, max(end, run.start() - 1), min(len(text), run.end() + 2)):
            if m.lastgroup != "phone" or 7 <= len(re.sub(r"\D", "", m[0])) <= 15:
                end = m.end()
                yield m.start(), m.end(), m.lastgroup


def _found(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text:
        for m in _EMAIL.finditer(text):
            yield m.start(), m.end(), "email"
    if _NUMBER.search(text):
        for m in _IBAN.finditer(text):
            own = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
                yield m.start(), m.end(), "iban"
        yield from _numbers(text)
    if not _CUES.isdisjoint(_CAPITAL.findall(text)):
        for m in _PERSON.finditer(text):
            yield m.start(), m.end(), "person"
    if _PHRASE.search(text):
        for m in _INTRODUCED.finditer(text):
            yield *m.span("name"), "person"
    if "<" in text and "@" in text:
        for m in _ADDRESSED.finditer(text):
            yield *m.span("name"), "person"


def _again(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Places of the names as whole words, also as parts of words with hyphens or apostrophes; the longest first."""
    most = max(len(_PART.findall(n)) for n in names)
    for m in _TOKEN.finditer(text):
        if m[0] in names:
            yield m.span()
            continue
        parts = list(_PART.finditer(text, *m.span()))
        k = 0
        while len(parts) > 1 and k < len(parts):
            spans = ((parts[k].start(), parts[e - 1].end(), e) for e in range(min(len(parts), k + most), k, -1))
            a, b, k = next(((a, b, e) for a, b, e in spans if text[a:b] in names), (0, 0, k + 1))
            if b:
                yield a, b


def _persons_joined(found: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The others as they come, then persons, overlapping ones as one."""
    persons: list[tuple[int, int]] = []
    for a, b, kind in found:
        if kind == "person":
            persons.append((a, b))
        else:
            yield a, b, kind
    persons.sort()
    start = end = 0
    for a, b in persons:
        if a >= end:
            if end:
                yield start, end, "person"
            start = a
        end = max(end, b)
    if end:
        yield start, end, "person"


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, the earlier kind of those above where two overlap.

    Names found with what stands around them are found again by themselves.
    """
    out: list[tuple[int, int, str]] = []
    for a, b, kind in _persons_joined(_found(text)) if text else ():
        k = bisect_left(out, (a,))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
            out.insert(k, (a, b, kind))
    if not out:
        return out
    titles = {t for ts in TITLES.values() for t in ts}
    names = {n for a, b, k in out if k == "person" for n in _NAME.findall(text[a:b]) if len(n) > 2 and n not in titles}
    if names:
        taken, spans = 0, sorted(out)
        for a, b in _again(text, names):
            while taken < len(spans) and spans[taken][1] <= a:
                taken += 1
            if taken == len(spans) or b <= spans[taken][0]:
                out.append((a, b, "person"))
    return sorted(out)


def replaced(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, length, kind, surrogate) of each entity, in the original's code points."""
    found = entities(text)
    if not found:
        return text, []
    parts, at, out = [], 0, []
    for a, b, kind in found:
        new = surrogates.of(kind, text[a:b])
        parts += [text[at:a], new]
        at = b
        out.append((a, b - a, kind, new))
    return "".join([*parts, text[at:]]), out


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, and entities (start, length, kind, surrogate) of each row.

    Null stays null, empty stays empty; rows are handled one by one (repeated rows alike), without a shuffle. Texts
    are searched whole, in time proportional to their length; other columns, whatever their names, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            done = [replaced(t, surrogates) for t in batch.column(1).to_pylist()]
            found = [[dict(zip(("start", "length", "kind", "surrogate"), e)) for e in es] for _, es in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(found, kind)], ["doc_id", "text", "entities"])

    return texts(docs).mapInArrow(run, "doc_id bigint, text string, entities array<struct<start: bigint, length: bigint, kind: string, surrogate: string>>")


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """Surrogates that stand for more than one entity (compared without case and separators): none, by design."""
    done = pseudonymise(docs, key).select("doc_id", F.explode("entities").alias("e"))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s()-]", "")
    original = texts(docs).withColumnRenamed("text", "original").join(done, "doc_id")
    pairs = original.select("e.kind", plain(F.col("e.surrogate")).alias("surrogate"), plain(F.expr("substring(original, cast(e.start + 1 as int), cast(e.length as int))")).alias("entity")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
