"""Pseudonyms: values next to other numbers and words, and phones in all spellings."""

import random
import re

from tessera.llm import pseudonyms as P

KEY = b"k"
CARD, IBANS = "4041894974608795", ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "DE89370400440532013000", "NO93 8601 1117 947"]


def test_cards_beside_numbers():
    link = re.sub(" ", "", P.replace(CARD, KEY)[0])
    spaced = "4041 8949 7460 8795"
    for t in (f"{CARD} 123", f"item 12 {CARD}", f"{spaced} 12/27", f"{spaced} 12 2027", f"12 34 56 {spaced}", f"{CARD}-12", f"{CARD} {CARD}"):
        new, found = P.replace(t, KEY)
        assert found == {"card": t.replace(" ", "").count(CARD)}, t
        assert spaced not in new and CARD not in new and link in new.replace(" ", "")
        assert P.reveal(new, KEY) == t
    assert P.replace("1234567890123456 12", KEY)[1] == {}


def test_ibans_beside_words():
    for iban in IBANS:
        for t in (iban, f"{iban} EUR", f"{iban} 2024", f"AB12 {iban} X1"):
            new, found = P.replace(t, KEY)
            assert found == {"iban": 1} and iban not in new and P.reveal(new, KEY) == t
            assert new.replace(P.replace(iban, KEY)[0], iban) == t


def test_spellings_of_a_phone_stay_linked():
    for spellings in (["+19885552485", "+1 (988) 555-2485", "+1-988-555-2485", "1-988-555-2485", "+1 988.555.2485"], ["+49301234567", "+49 30 1234567"], ["+35312345678", "+353 1 234 5678"]):
        out = [P.replace(f"x {s} y", KEY) for s in spellings]
        assert all(f == {"phone": 1} for _, f in out)
        assert len({re.sub(r"\D", "", n) for n, _ in out}) == 1
        assert all(P.reveal(n, KEY) == f"x {s} y" for (n, _), s in zip(out, spellings))


def test_round_trip_of_number_tables():
    rng = random.Random(9)
    for _ in range(400):
        t = "".join(f"{rng.randrange(10 ** rng.choice([1, 2, 4, 4, 4, 6, 16]))}{rng.choice('   -')}" for _ in range(rng.randint(3, 25))) + "1"
        assert P.reveal(P.replace(t, KEY)[0], KEY) == t
