"""Syntax that holds secrets: every part of one is found and redacted, and calls, variables and prose are not."""

import re

import pytest

from harbinger.llm import secrets


def pairs(text):
    return [text[i:j] for k, i, j, _ in secrets.spans(text) if k == "pair"]


@pytest.mark.parametrize(("text", "found"), [
    ('password = "abcD3f6H"          + "q9X7Zk2Lp0"', ['abcD3f6H"          + "q9X7Zk2Lp0']), ('password = "abcD3f6H" +\n\n  "q9X7Zk2Lp0"\n', ['abcD3f6H" +\n\n  "q9X7Zk2Lp0']),
    ('password = "abcD3f6H"\n  + "q9X7Zk2Lp0"\nx = "b7Yp3QmZx5Tn"', ['abcD3f6H"\n  + "q9X7Zk2Lp0']), ('A = "abcD3f6H"\nB = "q9X7Zk2Lp0"\npassword = A + B\n', ["abcD3f6H", "q9X7Zk2Lp0"]),
    ('A = "abcD3f6H"\nB = "q9X7Zk2Lp0"\nC = "b7" + A\npassword = C + B + "Yp3QmZ"\n', ["abcD3f6H", "q9X7Zk2Lp0", "Yp3QmZ"]), ('password = x + "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('password = "abcD3f6H" + x + "q9X7Zk2Lp0"', ['abcD3f6H" + x + "q9X7Zk2Lp0']),
    ('os.environ["SECRET_KEY"] = "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ("c['db']['password'] = 'q9X!w7Zk2Lp0'", ["q9X!w7Zk2Lp0"]), ('password = """q9X!w7Zk2Lp0"""', ["q9X!w7Zk2Lp0"]), ("password = '''q9X!w7\nZk2Lp0'''", ["q9X!w7\nZk2Lp0"]),
    ('"""Usage:\n    password = "q9X!w7Zk2Lp0"\n"""\nauth_token = "b7Yp3QmZx5Tn"\n', ["q9X!w7Zk2Lp0", "b7Yp3QmZx5Tn"]), ('class Token:\n    """Holds what a reader of Feeds needs, and more.\n    """\n', []), ("class Token:\n    '''What a Reader of feeds needs.'''\n", []),
    ('#define API_SECRET "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ("define('DB_PASSWORD', 'q9X!w7Zk2Lp0');", ["q9X!w7Zk2Lp0"]), ('string password = @"q9X!w7Zk2Lp0";', ["q9X!w7Zk2Lp0"]), ("password: 'q9X!w7''Zk2Lp0'", ["q9X!w7''Zk2Lp0"]),
    ('password = x or "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('password = process.env.PASSWORD || "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('password = a ?? "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('password = a ?: "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]),
    ('password = c ? "" : "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('password = "" if c else "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('password = os.getenv("PASSWORD_OF_Db9", "q9X!w7Zk2Lp0")', ["q9X!w7Zk2Lp0"]), ('password = get(\n  "db",\n  default="q9X!w7Zk2Lp0",\n)', ["q9X!w7Zk2Lp0"]),
    ('password = ask("a", "Please enter Your 1st password")', []), ("password = getpass.getPassFromStore9()", []), ("my_credential = settings.DATABASE_CREDENTIAL", []), ('my_credential = f(1\n\nname = g(1, "q9X!w7Zk2Lp0")', []),
    ("password: Dict[" + ", ".join(["str"] * 60) + '] = "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ('cfg.key = "q9X!w7Zk2Lp0"\npassword = cfg.key', ["q9X!w7Zk2Lp0"]), ('password = cfg.key\ncfg.key = "q9X!w7Zk2Lp0"', ["q9X!w7Zk2Lp0"]), ("my_credential = q9Xw7.Zk2Lp0", ["q9Xw7.Zk2Lp0"]),
])
def test_no_part_of_a_secret_is_left(text, found):
    assert pairs(text) == found
    assert not any(part in secrets.redact(text) for x in found for part in re.findall("[A-Za-z0-9!]{6,}", x))


def test_long_expressions_take_linear_time():
    n = 50_000  # each would take hours in quadratic time
    whole = 'password = "q9X!w7Zk2Lp0"' + ' + "b7Yp3QmZ"' * n
    assert pairs(whole) == [whole[12:-1]]
    assert pairs('A = "q9X!w7Zk2Lp0"\nB = "b7Yp3QmZx5Tn"\npassword = A' + " + B + A" * n) == ["q9X!w7Zk2Lp0", "b7Yp3QmZx5Tn"]
    assert pairs("my_credential = " + "f(1, " * n) == [] and pairs('my_credential = """' + "\n'''" * n) == []
    assert pairs("my_credential: " + "a " * n + '= "x" = "y"') == [] and pairs("my_cookie = x" + ' or "a b"' * n) == []
