"""Surrogates are of the type of what they stand for: 2,000 draws of each."""

import ipaddress
import random

import pytest

from tallyline.llm.pii import (
    _ISSUED,
    _NAMES,
    _formatted,
    _is_card,
    _kind_of_address,
    _luhn,
    _mod97,
    entity,
    mentions,
    replace_pii,
    surrogate,
)

DRAWS = 2_000


def drawn(kind, forms):
    """The surrogates of distinct forms; a permutation, so they are distinct, too."""
    forms = list(dict.fromkeys(forms))
    out = [surrogate(b"key", kind, f, 0) for f in forms]
    assert len(set(out)) == len(out)
    assert sum(a == b for a, b in zip(forms, out)) <= 2
    return list(zip(forms, out))


def found(text):
    return [(kind, text[start:end]) for start, end, kind, _ in mentions(text)]


def test_cards():
    rng = random.Random(1)
    heads = ["4", "51", "2221", "2720", "34", "37", "36", "3095", "3528", "3589", "6011", "5018", "2200", "9792", "6205"]
    lengths = {"34": 15, "37": 15, "36": 14}
    bodies = [h + "".join(rng.choices("0123456789", k=lengths.get(h, 16) - 1 - len(h))) for h in rng.choices(heads, k=DRAWS)]
    for card, new in drawn("card", [b + str(_luhn(b)) for b in bodies if _ISSUED.fullmatch(b + "0")]):
        assert _is_card(card) and _is_card(new) and len(new) == len(card) and new[:4] == card[:4]


def test_account_numbers():
    rng = random.Random(2)
    accounts = []
    for _ in range(DRAWS):
        country, shape = rng.choice([("DE", "d" * 18), ("GB", "aaaa" + "d" * 14), ("FR", "d" * 23), ("NO", "d" * 11), ("MT", "aaaa" + "d" * 5 + "a" * 18)])
        body = "".join(rng.choice("0123456789") if c == "d" else rng.choice("ABCDEFGH") for c in shape)
        accounts.append(f"{country}{98 - _mod97(country + '00' + body):02}{body}")
    for account, new in drawn("iban", accounts):
        assert _mod97(account) == 1 == _mod97(new) and new[:2] == account[:2]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in account]
        spaced = " ".join(account[i : i + 4] for i in range(0, len(account), 4))
        assert found(f"to {spaced} THE bank") == [("iban", spaced)]
        kind, text = found(f"to {account}.")[0]
        assert _formatted(kind, spaced, [new]).replace(" ", "") == new
    assert found("DE89370400440532013000") and not found("AB12 CDEF GHIJ KLMN")
    assert not [f for f in found("DE89 3704 0044 0532 0130 01") if f[0] == "iban"]


@pytest.mark.parametrize("network", ["0.0.0.0/0", "10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4"])
def test_addresses(network):
    rng, net = random.Random(3), ipaddress.ip_network(network)
    some = [str(net[rng.randrange(1, net.num_addresses - 1)]) for _ in range(DRAWS)]
    for address, new in drawn("ip", some):
        old, now = ipaddress.ip_address(address), ipaddress.ip_address(new)
        kind = _kind_of_address([int(o) for o in address.split(".")])
        assert _kind_of_address([int(o) for o in new.split(".")]) == kind
        if kind:
            assert (old.is_private, old.is_loopback, old.is_link_local, old.is_multicast) == (
                now.is_private, now.is_loopback, now.is_link_local, now.is_multicast
            )
    later = surrogate(b"key", "ip", "192.168.1.10", 9)
    assert later.startswith("10.")  # where a small network has no free address left


def test_longer_addresses():
    rng = random.Random(4)
    some = [f"{rng.choice((0x2001, 0xFE80, 0xFD12)):04x}" + f"{rng.getrandbits(112):028x}" for _ in range(DRAWS)]
    for address, new in drawn("ip6", some):
        assert new[:4] == address[:4] and len(new) == 32
    for text in ("2001:db8::8a2e:370:7334", "2001:0DB8:0000:0000:0000:8A2E:0370:7334", "fe80::1:2"):
        (kind, address), = found(f"from {text}, at 12:30:45")
        assert (kind, address) == ("ip6", text)
        new = _formatted(kind, address, [surrogate(b"key", *entity(kind, address)[0], 0)])
        assert ipaddress.ip_address(new) != ipaddress.ip_address(text) and new.isupper() == text.isupper()
        assert new.lower().startswith(text.lower()[:4])
    assert entity("ip6", "2001:db8::8a2e:370:7334") == entity("ip6", "2001:0DB8:0000:0000:0000:8A2E:0370:7334")
    assert found("at 12:30:45 or std::vector, a::b") == []


def test_social_security_numbers():
    rng = random.Random(5)
    valid = [f"{rng.choice([*range(1, 666), *range(667, 900)]):03}{rng.randrange(1, 100):02}{rng.randrange(1, 10_000):04}" for _ in range(DRAWS)]
    for _, new in drawn("ssn", valid):
        assert new[:3] not in ("000", "666") and new[0] != "9" and new[3:5] != "00" and new[5:] != "0000"
    drawn("ssn", [f"666{i:06}" for i in range(DRAWS)])


def test_phones_and_other_numbers():
    for phone in ("0049 30 1234567", "+49 30 1234567", "+1 (555) 123-4567", "(030) 123-4567", "612 345 678", "030 123 4567", "555-123-4567"):
        assert found(f"call {phone} now") == [("phone", phone)], phone
    for number in ("10 000 000", "12 500 600", "1.250.000", "100 000 000", "250 000 000 000"):
        assert found(f"paid {number} once") == [], number
    assert found("0.0.0.0 and 255.255.255.255") == []


@pytest.mark.parametrize("script, word", [("latin", "anna"), ("cyrillic", "анна"), ("greek", "άννα")])
@pytest.mark.parametrize("gender", "mfn")
def test_names(script, word, gender):
    names = _NAMES[script, gender]
    assert len(names) >= 600 and all(n[0].isupper() and n[1:].islower() for n in names)
    others = {n for g in "mfn" if g != gender for n in _NAMES[script, g]}
    assert len(set(names) & others) < len(names) / 10
    out = [surrogate(b"key", f"name {script}", f"{word}{i}", 0, gender) for i in range(DRAWS)]
    assert {o.capitalize() for o in out} <= set(names) and len(set(out)) > 0.5 * min(DRAWS, len(names))


def test_distinct_and_coreferent(spark):
    """More names than there are to draw, a full network, and repeats over rows."""
    texts = [f"Mr Xav{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} came from 192.168.7.{i % 256}" for i in range(1_000)]
    df = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    rows = {r.doc_id: r.text for r in replace_pii(df, b"k").collect()}
    names = [rows[i].split(" ")[1] for i in range(1_000)]
    assert len(set(names)) == 1_000 and not {t.split(" ")[1] for t in texts} & set(names)
    assert all(rows[i] == rows[i + 1_000] for i in range(1_000))
    addresses = {rows[i].split(" ")[-1] for i in range(1_000)}
    assert len(addresses) == 256 and all(a.startswith("192.168.") for a in addresses)
    assert not addresses & {f"192.168.7.{i}" for i in range(256)}
    with pytest.raises(ValueError):
        replace_pii(df, b"k", count_col="doc_id")
