import random
import string

import pytest
from codelode.llm.credentials import Finder

RNG = random.Random(6)
TOKEN = "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(900))
JWT = f"eyJhbGciOiJIUzI1NiJ9.eyJ{TOKEN}.{TOKEN[:43]}"
FILL = "var a=1;" * 800


@pytest.fixture(scope="module")
def finder():
    return Finder({"worker": 100, "queue": 100, "token": 100})


@pytest.mark.parametrize(
    ("before", "value", "after"),
    [
        ("x='", JWT, "'"), ("", JWT, " "), ("Authorization: Bearer ", TOKEN, ""), ("/files?v=1&token=", TOKEN, "'"), ("apiSecret='", TOKEN, "'"), ("password='", "a1;," * 300, "'"), ("redis://svc:", TOKEN, "@h.example/0"),
    ],
)
def test_values_on_long_lines_are_seen_to_their_end(finder, before, value, after):
    text = f"{FILL} {before}{value}{after};{FILL}"
    at = text.index(value)
    assert finder.find(text) == [[(at, at + len(value))]]


def test_long_lines_of_one_word_take_no_square_time(finder):
    assert finder.find("key" + "abcxoxkey" * 40_000) == []


def test_unended_key_is_masked_to_the_end_of_its_lines(finder):
    body = [TOKEN[i : i + 64] for i in range(0, 896, 64)] * 6
    text = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(body) + "\n\ndef configuration_of_workers():\n    return 1\n"
    (spans,) = finder.find(text)
    assert len(text) > 4000 and [text[a:b] for a, b in spans] == body
