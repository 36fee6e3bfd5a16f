import random
import string

import pytest
from codelode.llm.common import most_frequent
from codelode.llm.credentials import Finder

WORDS = {w: 100 for w in "password must have characters secret token worker queue ledger request header index label merge retry basin order value hook next silent packet".split()}
RANDOM = "F8ocqzYzfxlQzarj2xbqSvSU9zi63K7s"
RNG = random.Random(7)
LONG = "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(840))


@pytest.fixture(scope="module")
def finder():
    return Finder(WORDS)


@pytest.mark.parametrize(
    "line",
    [
        f'auth = "Bearer "+"{RANDOM}"', 'const k = process.env.DB_PASSWORD || "Hook#next16"', f't = os.environ.get("API_TOKEN") or "{RANDOM}"', f't = os.getenv("API_TOKEN", "{RANDOM}")', f'if token == "{RANDOM}":', f'"{RANDOM}" == token',
        'setPassword("Hook#next16")', 'client.login("admin", "Hook#next16")', 'auth=("admin", "Hook#next16")', 'requests.get(u, auth=("svc", "Hook#next16"))', 'const dbPass = "Hook#next16"', "DB_PASS=Hook#next16", 'passcode = "Hook#next16"',
        "<password>Hook#next16</password>", f'<add key="ApiSecret" value="{RANDOM}"/>', '<property name="password" value="Hook#next16"/>', "ENV DB_PASSWORD Hook#next16", "PGPASSWORD=Hook#next16 psql -h x", "curl -u a:Hook#next16 https://h", "mysql -u root -pHook#next16 db",
        "machine h.example login bob password Hook#next16", f'token = "".join(["{RANDOM}", "abc9"])', "// the password Hook#next16 works", 'password = "pa$$w0rd{9}"', 'password = "x9<Rt%4"', 'password = "Xq9 rT2 zz8 Lk"', 'pwd = "ab12"', 'if (password.equals("Hook#next16")) {',
        """curl -d '{"user": "a", "password": "Hook#next16"}' https://h""", """cmd = "psql user=a password='Hook#next16' host=h" """, f"""x = '<a token="{RANDOM}" b="c">'""",
        "spring.datasource.password=Hook#next16", f'x = "{RANDOM}"  # prod api token', 'new UsernamePasswordCredentials("bob", "Hook#next16")', f'jwt.verify(tok, secret="{RANDOM}")', f"headers: {{ 'X-Api-Key': '{RANDOM}' }}", "--password=Hook#next16", f"--token {RANDOM}",
        f'val apiKey by lazy {{ "{RANDOM}" }}', 'os.Setenv("DB_PASSWORD", "Hook#next16")', "define('DB_PASSWORD', 'Hook#next16');", ':password => "Hook#next16"', "Password=Hook#next16;Server=x", '{"user":"a","pass":"Hook#next16"}', '{\\"password\\":\\"Hook#next16\\"}',
        "- name: DB_PASSWORD\n  value: Hook#next16\n", '{"name": "DB_PASSWORD",\n "value": "Hook#next16"}', '{"name": "DB_PASSWORD", "value": "Hook#next16"}', "password: |\n  Hook#next16\n", f"token: >-\n  {RANDOM}\n", 'password =\n   "Hook#next16"', 'setPassword(\n  "Hook#next16")',
        f'# api token\nx = "{RANDOM}"\n', 'client.login(\n  "admin",\n  "Hook#next16")', f'SECRET = (\n    "{RANDOM[:12]}"\n    "{RANDOM[12:]}"\n)',
    ],
)
def test_contexts_on_both_sides(finder, line):
    assert len(finder.find(line)) == 1, line


@pytest.mark.parametrize(
    "text",
    [
        'password = "Password must have 8 characters"', '  "hazard_token0": 8572,', '"password": {\n "ledger_index1": {', 'pwd = "$DB_PWD"', 'password = "<your password 1>"', 'password = "my-password1"', 'const data = [\n  "' + RANDOM + '",\n  "' + RANDOM[::-1] + '"]',
        'token = "%(token)s"', 'getToken("ledger_index1")', 'x = token ? "label1" : "label2"', 'login("admin", "worker")', "password = userInput2", "token: Token1;", 'raise ValueError("password must have 8 characters")', "the password policy2 rules",
    ],
)
def test_no_credentials(finder, text):
    assert finder.find(text) == [], text


def test_a_long_token_on_a_long_line_is_found_whole(finder):
    text = "var a=1;" * 800 + f"apiToken='{LONG}';" + "var b=2;" * 400
    assert [[text[a:b] for a, b in v] for v in finder.find(text)] == [[LONG]]


def test_long_concatenations_take_no_square_time(finder):
    assert finder.find('"ab12" + ' * 30_000) == [] and len(finder.find("token = " + '"F8oc9zYz" + ' * 30_000 + '"x"')) == 1


def test_words_of_a_segmentation(finder):
    assert finder.seg.segments("packet-silent41") == (0, ("packet", "silent"))
    assert finder.seg.residual("zqxvw") == 5


def test_most_frequent_is_bounded(spark):
    counts = spark.range(1, 1001).selectExpr("id as word", "id as n")
    kept = [r["n"] for r in most_frequent(counts, "n", 100).collect()]
    assert 0 < len(kept) <= 100 and min(kept) > 1000 - 2 * 100 and max(kept) == 1000
    assert most_frequent(counts.limit(0), "n", 100).count() == 0
