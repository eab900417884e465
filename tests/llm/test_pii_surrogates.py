from __future__ import annotations

import re

import pytest

from tableweave.llm import pii_surrogates as P


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, kind string, __id int")
    out = P.replace_personal_data(docs, key)
    assert out.columns == ["doc_id", "text", "kind", "__id", "n_entities"]
    return [r.text for r in out.orderBy("doc_id").collect()]


CASES = [
    ("write to Jo.Doe_7@mail3.example.com now", r"write to [A-Z][a-z]\.[A-Z][a-z]{2}_\d@[a-z]{4}\d\.[a-z]{7}\.com now"),
    ("call +1 (551) 555-0826 on", r"call \+1 \(\d{3}\) \d{3}-\d{4} on"),
    ("CALL!! +1!! (551)!! 555-0826!! ON!!", r"CALL!! \+1!! \(\d{3}\)!! \d{3}-\d{4}!! ON!!"),
    ("from 194.209.21.243.", r"from \d+\.\d+\.\d+\.\d+\."),
    ("pay 4225039295678253!! and", r"pay 4\d{15}!! and"),
    ('token = "186661156f3f9905942d70850a01cbf23a203f82"', r'token = "[0-9a-f]{40}"'),
    ('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', r'TOKEN = "[0-9A-F]{40}"!!'),
    ("id 123-45-6789 here", r"id \d{3}-\d{2}-\d{4} here"),
    ("Frau Erika Mustermann kam", r"Frau (?:" + "|".join(P.GIVEN["female"]) + r") [A-Z][a-z]{9} kam"),
    ("Mr. Smith left", r"Mr\. [A-Z][a-z]{9} left"),
    ("Господин Иван Петров ушёл", r"Господин [А-Я][а-яё]+ [А-Я][а-я]{9} ушёл"),
    ("iban DE44500105175407324931 ok", r"iban DE\d{20} ok"),
    ("öä.24@mail1.example.com", r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com"),
]


def test_kinds_and_formats(spark):
    texts = [c[0] for c in CASES]
    for (text, shape), got in zip(CASES, replaced(spark, texts), strict=True):
        assert re.fullmatch(shape, got), (text, got)
        assert got != text


def test_clean_and_degenerate_texts_stay(spark):
    texts = [None, "", "no data 12 345 | 6.5", "a@b", "1.2.3", "x" * 50_000 + " 12", "3.14159265358979", "2024-01-02 10:20:30"]
    assert replaced(spark, texts) == texts
    assert P.replace_personal_data(spark.createDataFrame([], "doc_id long, text string, n_entities int"), "k").count() == 0


def test_coreference_distinctness_and_key(spark):
    texts = [f"u{k}@a{k % 3}.example.com and 10.0.0.{k} +1 (551) 555-{k:04d} 411111111111{k:04d}" for k in range(200)]
    texts += [t.upper() for t in texts[:50]] + texts[:5]
    got = replaced(spark, texts)
    assert [g.lower() for g in got[200:250]] == [g.lower() for g in got[:50]] and got[250:] == got[:5]
    originals = {w for t in texts for w in t.split()}
    for column in (0, 2, 6):
        values = [g.split()[column] for g in got[:200]]
        assert len(set(values)) == 200 and not set(values) & originals
    assert len({" ".join(g.split()[3:6]) for g in got[:200]}) == 200
    assert replaced(spark, texts[:3], "other") != got[:3] and replaced(spark, texts[:3]) == got[:3]


def test_collisions_are_drawn_again(spark, monkeypatch):
    entities = spark.createDataFrame([("phone", f"{k:03d}") for k in range(0, 400, 2)], "kind string, normal string")
    given = P.assign_surrogates(entities, "k").collect()
    taken = {r.surrogate for r in given}
    assert len(given) == len(taken) == 200 and not taken & {r.normal for r in given}
    monkeypatch.setattr(P, "ROUNDS", 2)
    full = spark.createDataFrame([("phone", str(k)) for k in range(10)], "kind string, normal string")
    with pytest.raises(ValueError):
        P.assign_surrogates(full, "k")


def test_card_numbers_keep_their_check_digit(spark):
    def luhn(x: str) -> bool:
        ds = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(x))]
        return sum(d - 9 if d > 9 else d for d in ds) % 10 == 0

    texts = ["4111111111111111", "4111111111111112", "5500 0000 0000 0004", "378282246310005"]
    for a, b in zip(texts, replaced(spark, texts), strict=True):
        assert luhn(a.replace(" ", "")) == luhn(b.replace(" ", "")) and a[0] == b[0]


def test_every_entity_gets_a_surrogate(spark):
    secrets = ["P@ssw0rd!", "jo@example.com", "********", "密码密码密码密码", "סיסמהסודית", "รหัสผ่านลับ", "4225039295678253", "пароль-пароль"]
    emails = ["张伟@例子.中国", "علي@مثال.com", "דני@דוגמה.co"]
    got = replaced(spark, [f'password = "{x}"' for x in secrets] + [f"to {x} now" for x in emails])
    for x, y in zip(secrets, got, strict=False):
        assert re.fullmatch(r'password = "[^\s"]{8,}"', y) and x not in y and len(y) == 13 + len(x)
    for x, y in zip(emails, got[len(secrets) :], strict=True):
        assert re.fullmatch(r"to \S+@\S+ now", y) and x not in y
    assert re.fullmatch(r"[一-鿿]{8}", got[3][12:-1]) and re.fullmatch(r"\d{16}", got[6][12:-1])


def test_full_formats(spark, monkeypatch):
    monkeypatch.setattr(P, "LONGER_AFTER", 1)
    monkeypatch.setattr(P, "ROUNDS", 2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}.co") for a in letters for b in letters] + [("phone", f"{k:02d}") for k in range(50)] + [("phone", f"+1{k:02d}") for k in range(49)]
    rows += [("ip", f"1.2.3.{k}") for k in range(9)]
    given = P.assign_surrogates(spark.createDataFrame(rows, "kind string, normal string"), "k").collect()
    taken = {(r.kind, r.surrogate) for r in given}
    assert {(r.kind, r.normal) for r in given} == set(rows) and len(taken) == len(given) == len(rows) and not taken & set(rows)
    assert all(r.surrogate.endswith(".co") for r in given if r.kind == "email")
    assert all(re.fullmatch(r"\+1\d\d" if r.normal[0] == "+" else r"\d\d", r.surrogate) for r in given if r.kind == "phone")


ORDINARY = [
    ("Mr McDonald left", r"Mr [A-Z][a-z]{9} left"),
    ("Mrs O'Brien's house", r"Mrs [A-Z][a-z]{9}'s house"),
    ("Dr. J. Smith and", r"Dr\. [A-Z]\. [A-Z][a-z]{9} and"),
    ("MR SMITH came", r"MR [A-Z]{10} came"),
    ("Mr John Paul Smith left", r"Mr [A-Z][a-z]+ [A-Z][a-z]{9} left"),
    ("Frau Müller-Lüdenscheidt kam", r"Frau [A-Z][a-z]{9} kam"),
    ("Herr von Neumann kam", r"Herr [A-Z][a-z]+ [A-Z][a-z]{9} kam"),
    ("call 555-123-4567 or", r"call \d{3}-\d{3}-\d{4} or"),
    ("call 555.123.4567.", r"call \d{3}\.\d{3}\.\d{4}\."),
    ("call 555 123 4567, (555)123-4567", r"call (\d{3}) (\d{3}) (\d{4}), \(\1\)\2-\3"),
    ('{"password": "hunter2hunter2"}', r'\{"password": "[a-z]{6}\d[a-z]{6}\d"\}'),
    ("DB_PASSWORD=correcthorse.", r"DB_PASSWORD=[a-z]{12}\."),
    ("api_key: abcd1234efgh next", r"api_key: [a-z]{4}\d{4}[a-z]{4} next"),
    ("from 2001:db8::8a2e:370:7334 to", r"from [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} to"),
    ("from FE80:0:0:0:0202:B3FF:FE1E:8329", r"from [0-9A-F]{4}(:[0-9A-F]){3}(:[0-9A-F]{4}){4}"),
    ("from ::ffff:192.168.10.20", r"from ::ffff:\d+\.\d+\.\d+\.\d+"),
]
PLAIN = ["the password: remember it", "token = value", "std::cout x[1::2] 10:20:30 00:1A:2B:3C:4D:5E", "ISBN 978-316-1484-10-0", "password = getPassword()", "Mr left"]


def test_ordinary_formats(spark):
    got = replaced(spark, [x[0] for x in ORDINARY] + PLAIN)
    for (text, shape), y in zip(ORDINARY, got, strict=False):
        assert re.fullmatch(shape, y) and y != text, (text, y)
    assert got[len(ORDINARY) :] == PLAIN


def iban_valid(x):
    turned = x[4:] + x[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


HARD = [
    ("Prof. Dr. Hans Meier sprach", r"Prof\. Dr\. [A-Z][a-z]+ [A-Z][a-z]{9} sprach"),
    ("Frau Prof. Dr. Erika Meier, Mr. Smith Jr. left", r"Frau Prof\. Dr\. (?:" + "|".join(P.GIVEN["female"]) + r") [A-Z][a-z]{9}, Mr\. [A-Z][a-z]{9} Jr\. left"),
    ("Mr. John Smith came, then Mr. Smith and MR. SMITH left", r"Mr\. [A-Z][a-z]+ ([A-Z][a-z]{9}) came, then Mr\. \1 and MR\. (?i:\1) left"),
    ("Mr 山田太郎 came", r"Mr [一-鿿]{4} came"),
    ("Mr John Smith met John  Smith and Mr  Adams III.", r"Mr ([A-Z][a-z]+ [A-Z][a-z]{9}) met \1 and Mr  [A-Z][a-z]{9} III\."),
    ("Mr John Smith, Mrs Jane Smith and Dr Smith", r"Mr [A-Z][a-z]+ ([A-Z][a-z]{9}), Mrs [A-Z][a-z]+ (?!\1)([A-Z][a-z]{9}) and Dr (?!\1|\2)[A-Z][a-z]{9}"),
]


def test_hard_names(spark):
    got = replaced(spark, [x[0] for x in HARD])
    for (text, shape), y in zip(HARD, got, strict=True):
        assert re.fullmatch(shape, y) and not set(re.findall(r"Meier|Smith|SMITH|Hans|John|Adams|山田|太郎", y)), (text, y)


def test_account_numbers_keep_their_check_digits(spark):
    texts = ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "DE00370400440532013000", "FR1420041010050500013M02606"]
    for a, b in zip(texts, replaced(spark, texts), strict=True):
        x, y = a.replace(" ", ""), b.replace(" ", "")
        assert x[:2] == y[:2] and len(x) == len(y) and x != y and iban_valid(x) == iban_valid(y), (a, b)


def test_domains_stay_apart(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    got = replaced(spark, [f"jo.doe@{c}.org" for c in letters] + [f"ann.lee@{c}.org" for c in letters])
    domains = [x.split("@")[1] for x in got]
    assert len(set(domains[:26])) == 26 and domains[:26] == domains[26:] and not set(domains) & {f"{c}.org" for c in letters}


def test_counted_surrogates_are_the_free_ones_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 16)
    rest = spark.createDataFrame([("phone", f"{k:03d}") for k in range(0, 900)], "kind string, normal string")
    used = spark.createDataFrame([("phone", f"{k:03d}") for k in range(0, 50)], "kind string, surrogate string")
    got = P.enumerated(rest, used, "k").collect()
    assert len({r.normal for r in got}) == len(got) == 900 == len({r.surrogate for r in got})
    assert not {r.surrogate for r in got} & {f"{k:03d}" for k in range(50)}


def test_three_hundred_texts_against_their_templates(spark):
    """Texts are templates with entities put in: what was put in place of each is read back by the template alone, and
    must be a one-to-one map of the entities, over all texts, that leaves everything else as it was."""
    import random

    r = random.Random(8)
    words = "der bote kam spät und went home avec une lettre de hier".split()
    last = ["Meier", "Schulze", "O'Neill", "Duval", "Krüger-Lang"]
    people = [(t, g, n) for t, g in (("Herr", "Bert"), ("Frau", "Rosa"), ("Mr.", "Walt"), ("Mme", None)) if g for n in last]
    pools = {
        "email": [f"{a}.{n}@{d}.example.com" for a in ("jo", "al") for n in ("doe", "roe") for d in ("mail", "web")],
        "ip": [f"10.20.{k}.7" for k in range(6)],
        "phone": [f"+49 (551) 555-{k:04d}" for k in range(6)],
        "card": ["4111111111111111", "5500000000000004"],
        "name": [f"{t} {g} {n}" for t, g, n in people],
    }
    texts, templates = [], []
    for _ in range(300):
        parts, shape, put = [], [], []
        for _ in range(r.randint(0, 4)):
            kind = r.choice(list(pools))
            value = r.choice(pools[kind])
            plain = " ".join(r.choices(words, k=r.randint(1, 5)))
            shown = value.upper() if kind == "email" and r.random() < 0.3 else value
            parts += [plain, shown]
            shape += [re.escape(plain), {"email": r"(\S+@\S+)", "ip": r"([0-9.]+)", "phone": r"(\+\d\d \(\d{3}\) \d{3}-\d{4})", "card": r"(\d{16})", "name": r"(\S+ [^\W\d_]+ [^\W\d_]+)"}[kind]]
            put.append((kind, value))
        parts.append("ende")
        shape.append("ende")
        texts.append(" ".join(parts))
        templates.append((" ".join(shape), put))
    given = {}
    for text, got, (shape, put) in zip(texts, replaced(spark, texts), templates, strict=True):
        m = re.fullmatch(shape, got)
        assert m, (text, got)
        for (kind, value), new in zip(put, m.groups(), strict=True):
            new = new.lower() if kind == "email" else new
            assert given.setdefault((kind, value), new) == new and new != value
            assert kind != "name" or new.split()[0] == value.split()[0]
    assert len(set(given.values())) == len(given) and not {v.lower() for v in given.values()} & {k[1].lower() for k in given}
    assert len({v.split()[-1] for (k, _), v in given.items() if k == "name"}) == sum(k == "name" for k, _ in given)
