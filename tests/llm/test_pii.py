import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratavec.llm import pii

S = pii.Surrogates(b"k")


@given(st.integers(2, 300), st.integers(0, 5))
def test_permutation_without_fixed_points(n, label):
    image = [S.permuted(x, n, ("t", label)) for x in range(n)]
    assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image))


def test_kinds():
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", S.phone("+1 (212) 555-0187"))
    card = S.card("4539 1488 0343 6467")
    assert pii.luhn("4539148803436467") % 10 == 0 and pii.luhn(card.replace(" ", "")) % 10 == 0 and card[0] == "4" and card[4] == " "
    assert pii.luhn(S.card("4539148803436468")) % 10 != 0
    iban = S.iban("DE89 3704 0044 0532 0130 00")
    assert iban[:2] == "DE" and [len(x) for x in iban.split()] == [4, 4, 4, 4, 4, 2] and pii.entities(iban)[0][2] == "iban"
    assert S.ip("192.168.1.7").startswith("192.168.") and S.ip("10.1.2.3").startswith("10.") and not S.ip("8.8.8.8").startswith(("10.", "127."))
    assert re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.com", S.email("jane.42@mail7.com"))
    assert S.ssn("123-45-6789") != "123-45-6789"


@pytest.mark.parametrize("gender,script", pii.GIVEN)
def test_names_keep_gender_and_script(gender, script):
    names = pii.GIVEN[gender, script]
    assert sorted(map(S.name, names)) == sorted(names) and all(S.name(n) != n for n in names)


def test_unknown_names_keep_script_and_form_and_never_meet_listed_ones():
    assert re.fullmatch("[А-ЯЁ][а-яё]{5}", S.name("Петров")) and re.fullmatch("[A-Z][a-z]{6}", S.name("Schmidt")) and S.name("SCHMIDT") == S.name("Schmidt").upper()
    given = [n for a in "KLMN" for b in "aeiou" for c in "rstv" for d in "aeiou" if (n := a + b + c + d).lower() not in pii._KNOWN]
    made = set(map(S.name, given))
    assert len(made) == len(given) and not {n.lower() for n in made} & set(pii._KNOWN)


def test_coreference_and_distinctness():
    text = "Dr. Anna Schmidt met Herr Peter Schmidt. Schmidt said: mail ANNA@x.org or anna@x.org, not anne@x.org."
    new, found = pii.replaced(text, S)
    names = [w for w in re.findall(r"[A-Z]\w+", new)]
    assert new.count(S.name("Schmidt")) == 3 and "Schmidt" not in new and "Anna" not in names
    mails = [e[3] for e in found if e[2] == "email"]
    assert mails[0].lower() == mails[1] != mails[2]


EDGES = [(1, None), (2, ""), (3, "nothing here 12 345"), (4, "call +1 (212) 555-0187 or 212-555-0187"), (4, "call +1 (212) 555-0187 or 212-555-0187"), (None, "9.9.9.9"), (5, "a@b.com " * 20_000)]


def test_edges(spark):
    docs = spark.createDataFrame([(d, t, "e") for d, t in EDGES], "doc_id bigint, text string, entities string").repartition(2)
    rows = pii.pseudonymise(docs, b"k").collect()
    got = sorted([(r.doc_id, len(r.entities)) for r in rows], key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 0), (4, 2), (4, 2), (None, 1), (5, 20_000)], key=str)
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[3].text == EDGES[2][1] and by[4].text == pii.replaced(EDGES[3][1], S)[0]
    for r in rows:
        for e in r.entities[:50]:
            assert e.surrogate in r.text
    assert pii.pseudonymise(docs.limit(0), b"k").count() == 0


def test_cheap_scans_miss_nothing(spark):
    """Against the plain patterns over whole texts; and no surrogate stands for two entities."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plain = re.compile("|".join(f"(?P<{k}>{pii.PATTERNS[k]})" for k in ("email", "ip", "ssn", "phone", "card")))
    for r in docs.where("text rlike '[0-9@]'").limit(1500).collect():
        want = {(m.start(), m.end(), m.lastgroup) for m in plain.finditer(r.text)}
        assert {e for e in pii.entities(r.text) if e[2] not in ("person", "iban")} == want
    assert pii.collisions(docs, b"k").count() == 0


def test_long_entities():
    """Letters are permuted in blocks: no limit of digits, distinct values stay distinct, time stays in proportion."""
    began = time.perf_counter()
    made = set()
    for k in range(3):
        address = f"{'bcdfg' * 20_000}{'xyz'[k]}{'aeiou' * 100}@x.org"
        text, found = pii.replaced(f"write {address} or {address.upper()} now", S)
        (a, _, _, one), (_, _, _, two) = found
        assert a == 6 and len(one) == len(address) and one != address and one.lower() == two.lower() and address not in text
        made.add(one)
    assert len(made) == 3
    for text in ("%" * 300_000, "a." * 150_000, "Anna-" * 60_000, "my name is " * 30_000, "Xa Xb " * 50_000 + "<a@b", " ".join(f"Mr X{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz' * (k // 100)}" for k in range(2000))):
        pii.replaced(text, S)
    assert time.perf_counter() - began < 60
    name, found = pii.replaced(f"Dr. A{'b' * 100_000} is here", S)
    assert found[0][1] == 100_005 and re.fullmatch(r"Dr\. [A-Z][a-z]{100000} is here", name)


def test_names_by_context():
    for text, names in (
        ("Hello, my name is Kofi Mensah. Mensah lives here", {"Kofi Mensah", "Mensah"}),
        ("write to Giovanni Rossi <g.rossi@x.org>, not to Wei", {"Giovanni Rossi"}),
        ("Sincerely,\nAmara Okafor", {"Amara Okafor"}),
        ("Меня зовут Тимур Ахметов и", {"Тимур Ахметов"}),
        ("Ich heiße Jörg Übel, nicht", {"Jörg Übel"}),
        ("Patient: Wei Zhang Li, 40", {"Wei Zhang Li"}),
        ("full name: Αλέξης Ζορμπάς and", {"Αλέξης Ζορμπάς"}),
        ("my name is not given, and Public License stays", set()),
    ):
        found = [(a, b) for a, b, k in pii.entities(text) if k == "person"]
        assert {text[a:b] for a, b in found} == names
        new, _ = pii.replaced(text, S)
        assert len(new) >= len(text) - 20 and not any(w in new.split() for n in names for w in n.split())


def plain_persons(text):
    """Names by the patterns over the whole text, and again by a plain search for each name found."""
    spans = [m.span() for m in re.finditer(pii.PATTERNS["person"], text)]
    spans += [m.span("name") for k in ("introduced", "addressed") for m in re.finditer(pii.PATTERNS[k], text)]
    covered = sorted({p for a, b in spans for p in range(a, b - 1)})  # gaps of a pair of neighbours that one span covers
    return [(a, max(b for b in [a + 1, *(p + 2 for p in covered)] if set(range(a, b - 1)) <= set(covered))) for a in {a for a, _ in spans} if a - 1 not in covered]


def plain_iban(s):
    """Whether the digits, with letters as numbers from 10, leave 1 when divided by 97: digit by digit."""
    own, rest = s.replace(" ", ""), 0
    for c in own[4:] + own[:4]:
        for digit in str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)):
            rest = (rest * 10 + int(digit)) % 97
    return rest == 1


def test_persons_and_ibans_match_a_plain_search(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[A-Z]{2}[0-9]{2}|Mr|Mrs|Dr|Anna|John|Maria|Peter'").limit(1500).collect()]
    docs += ["Dr. Anna Schmidt met Peter Müller; Schmidt and Anna-Maria said O'Neil. Mr O'Neil-Smith, O'Neil-Smith!", "DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00 GB82WEST12345698765432", "Anna Smith Anna2 Anna_ Smithson Smith-Anna-Jones"]
    rng = np.random.default_rng(6)
    given, titles = [n for ns in pii.GIVEN.values() for n in ns], [x for xs in pii.TITLES.values() for x in xs]
    last = ["Okafor", "Müller-Lüdenscheidt", "O'Neil", "Петров", "Zhang", "Anna", "de", "smith", "Smith2"]
    pieces = (
        lambda: f"{rng.choice(titles)}. {rng.choice(last)}", lambda: f"{rng.choice(given)} {rng.choice(last)}", lambda: str(rng.choice(last)), lambda: "the house, and", lambda: f"my name is {rng.choice(last)} {rng.choice(last)}.",
        lambda: S.iban("DE89 3704 0044 0532 0130 00"), lambda: f"GB{rng.integers(10, 99)}WEST123456987654{rng.integers(10, 99)}", lambda: f"{rng.choice(last)} {rng.choice(last)} <x@y.org>",
    )
    docs += [" ".join(pieces[k]() for k in rng.integers(0, len(pieces), 30)) for _ in range(60)]
    seen = 0
    for text in docs:
        found = pii.entities(text)
        taken = [(a, b) for a, b, k in found if k not in ("person", "iban")]
        free = lambda a, b, spans: not any(x < b and a < y for x, y in spans)
        ibans = {(m.start(), m.end()) for m in re.finditer(pii.PATTERNS["iban"], text) if plain_iban(m[0])}
        assert {(a, b) for a, b, k in found if k == "iban"} == {s for s in ibans if free(*s, [x for x in taken if x[0] < s[0] and text[x[0] : x[1]].count("@")])}
        persons = {s for s in plain_persons(text) if free(*s, [(a, b) for a, b, k in found if k != "person"])}
        got = {(a, b) for a, b, k in found if k == "person"}
        titles = {t for ts in pii.TITLES.values() for t in ts}
        names = {n for a, b in persons for n in re.findall(pii._CAP, text[a:b]) if len(n) > 2 and n not in titles}
        again = {m.span() for n in names for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text)}
        # each plain one is found or lies in or over a found one, and nothing else is found
        assert all(s in got or not free(*s, got) or not free(*s, [(a, b) for a, b, k in found if k != "person"]) for s in persons | again)
        assert got <= persons | again
        seen += len(got) + len(ibans)
    assert seen > 500
