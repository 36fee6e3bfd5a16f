import pytest
from codelode.llm.credentials import PASSWORD_WORDS, SECRET_WORDS, Finder

WORDS = {w: 100 for w in "password must have characters secret token worker queue ledger request header index label merge retry basin order value timber mirror quartz".split()}
RANDOM = "F8ocqzYzfxlQ" + "zarj2xbqSvSU9zi63K7s"


@pytest.fixture(scope="module")
def finder():
    return Finder(WORDS)


@pytest.mark.parametrize("word", sorted(PASSWORD_WORDS | SECRET_WORDS))
def test_every_word_alone_is_enough(finder, word):
    assert len(finder.find(f'{word} = "{RANDOM}"')) == 1
    assert len(finder.find(f"export SMTP_{word.upper()}={RANDOM}")) == 1


@pytest.mark.parametrize(
    "line",
    [
        "SMTP_PASS=Hook#next16", 'const smtpPass136 = "Partial-Parcel1757";', f"see /files?v=1&sig={RANDOM}", f"see /files?v=1&signature={RANDOM}", 'client.connect("svc-hinge", "Late-Node5060");', 'client.Login("svc-module", "Meadow43!")',
        'const x = "zk1.4HAw3MtjbA5sdonNNOVULd.yoRwG75TLG";', f'send("{RANDOM}")', f"LABEL={RANDOM}", "curl -u svc-engine:Ember82! h.example", "# old login: ridge / Daemon48!",
    ],
)
def test_finds_without_a_needle_of_old(finder, line):
    assert len(finder.find(line)) == 1, line


@pytest.mark.parametrize("line", [f'"{RANDOM}",', f'content_digest = "{RANDOM}"', 'commit = "843ce06d7b74d974c3e66a7ce31a5ae79366476f"', 'client.connect("localhost", "5432")', 'x = "queue_worker_ledger_request"'])
def test_leaves_literals_that_nothing_assigns_or_explains(finder, line):
    assert finder.find(line) == [], line
