"""What counts as personal data, and what stays."""

import re

import pytest

from tallyline.llm.pii import mentions, replace_pii


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in replace_pii(df, b"k").orderBy("doc_id").collect()]


def kinds(text):
    return [(kind, text[start:end]) for start, end, kind, _ in mentions(text)]


CARDS = ["4111 1111 1111 1111", "5555555555554444", "2223-0031-2200-3222", "3782 822463 10005", "30569309025904",
         "6011111111111117", "3530111333300000", "4222222222222", "6205500000000000004"]


@pytest.mark.parametrize("card", CARDS)
def test_cards(card):
    assert kinds(f"pay {card}, now") == [("card", card)]
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    assert kinds(f"pay {wrong}, now") == []


def test_numbers_that_are_no_cards(spark):
    # a bad checksum, and a good one without an issuer
    texts = ["order 9807915762804490 of 2428694969355626", "4111 1111 1111 1112", "1234-5678-9012-3456 555", "time 1234567890123", "0000000000000000"]
    assert replaced(spark, *texts) == texts
    assert kinds("4111 1111 1111 1111 737 is the check number") == [("card", "4111 1111 1111 1111")]
    assert kinds("0049 1512 3456 7890") == [("phone", "0049 1512 3456 7890")]
    valid, = replaced(spark, "card 4111111111111111")
    assert re.fullmatch(r"card \d{16}", valid) and "4111111111111111" not in valid


def test_names_are_the_same_everywhere(spark):
    texts = [
        "Mr Smith met Mr John Smith. Smith's friend, SMITH, John and smithy Blacksmith stayed; Smith-led too.",
        "Dr Anna Lee wrote. Mrs Anna Lee read, Anna agreed.",
        "Mr Lee's house and Prof. Anna Smith",
        "Smith and Anna without any title",
    ]
    first, second, third, last = replaced(spark, *texts)
    smith, john = re.match(r"Mr (\S+) met Mr (\S+) ", first).groups()[0], re.search(r"met Mr (\S+) ", first)[1]
    assert first == f"Mr {smith} met Mr {john} {smith}. {smith}'s friend, {smith.upper()}, {john} and smithy Blacksmith stayed; {smith}-led too."
    anna, lee = re.match(r"Dr (\S+) (\S+) wrote", second).groups()
    assert second == f"Dr {anna} {lee} wrote. Mrs {anna} {lee} read, {anna} agreed."
    assert third == f"Mr {lee}'s house and Prof. {anna} {smith}"
    assert last == texts[3] and len({smith, john, anna, lee}) == 4
    from tallyline.llm.pii import _NAMES

    assert john in _NAMES["latin", "m"] and anna in _NAMES["latin", "f"]


SECRETS = [
    'token = "{}"', 'Secret = "{}"', 'password = "{}"', 'API_KEY="{}"', "key: '{}'", "PASSWORD={}", "password: {}", "apiKey: `{}`",
    "client_secret:{}", '{{"access_token": "{}"}}', "db-password => '{}'", "token={}&x=y", "pwd := {}.", "Mot de passe : {}", 'authkey={}',
    '\\"secret\\": \\"{}\\"', "token = {}",
]


@pytest.mark.parametrize("form", SECRETS)
def test_secrets_in_texts_without_digits(form):
    for value in ("correcthorsebattery", "Aq+/xZ-_kLmN=="):
        assert kinds(form.format(value)) == [("secret", value)]


def test_hashes(spark):
    low, mixed = "d41d8cd98f00b204e9800998ecf8427e", "D41d8cd98F00b204e9800998ecf8427e"
    assert kinds(f"{low} at the start") == [("secret", low)] and kinds(f"is {mixed}") == [("secret", mixed)]
    new, = replaced(spark, f"is {mixed}")
    assert re.fullmatch(r"is [0-9a-fA-F]{32}", new) and mixed not in new


def test_no_secrets():
    for text in ("The key: understanding each other", "monkey = 'orangutans'", "keyboard: 'mechanical'", "key = short", "token = readToken()",
                 "password: ${FROM_ENVIRONMENT}", "secretary: somebody", "the password is forgotten"):
        assert kinds(text) == [], text
    assert kinds("key: ann@mail.example") == [("email", "ann@mail.example")]
