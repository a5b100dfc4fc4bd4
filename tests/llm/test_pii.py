import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, (_, p) in enumerate(BASE) for m in re.finditer(p, text or "") if passes(BASE[k][0], m.group())]


def card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def make_texts(seed, n=250):
    rng = random.Random(seed)
    pieces = ["a@b.c", "x_@d.e", "@", ".", "..", "a.b-c%d+e@mail.example.com", "@d.e", "1.2.3.4", "300.1.1.1", "0001.002.3.4.5.6.7.8", "+1 (443) 555-5793", "+12", "+1-+2 33 44 55 66 7", "(614) 555-8001", "é", "🙂", " ", " ", "\n", "word", "id 12345678", "token = \"%040x\"", "key=%s", "12 34", "4", "%", "-", "_"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(14)):
            p = rng.choice(pieces + ["CARD", "CARD"])
            if p == "CARD":
                p = card(rng, rng.randrange(15, 21))
                if rng.random() < 0.5:
                    p = rng.choice(" -").join(p[i : i + 4] for i in range(0, len(p), 4))
            elif p == 'token = "%040x"':
                p = f'token = "{rng.getrandbits(160):040x}"'
            elif p == "key=%s":
                p = f"key={rng.getrandbits(40)}"
            parts.append(p)
        texts.append(rng.choice(["", " "]).join(parts))
    return texts


def test_base_spans_and_redaction(spark):
    texts = make_texts(3) + [None, "", "b." * 3000 + "c@" + "d." * 3000 + "e", "1" * 5000 + " " + "+1 " * 3000, "1.2.3.4 " * 3000]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, "mail a@b.c", 1, "x"), (None, "mail a@b.c", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int, key string")
    found = pii.find_personal_data(docs)
    got = found.select("doc_id", "base", "added", F.sha2(pii.joined_names(F.col("base")), 256).alias("sha")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "mail a@b.c" if r["doc_id"] is None else texts[r["doc_id"]]
        want = brute(text)
        assert [tuple(s) for s in r["base"]] == want, text
        assert r["sha"] == hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        for k, a, b in r["added"]:
            assert 0 <= a < b <= len(text) and all(b <= x or a >= y for _, x, y in want)
            if k == 4:
                assert re.fullmatch(r"[A-Za-z0-9_-]{16,}", text[a:b])
    hexes = [t for t in texts if t and re.search(r'(?<![0-9A-Za-z_-])[0-9a-f]{40}"', t)]
    assert sum(any(s[0] == 4 for s in r["added"]) for r in got) >= 0.8 * len(hexes) > 0


def test_redact(spark):
    row = spark.createDataFrame([("é a@b.c, then 1.2.3.4!", [(1, 14, 21), (0, 2, 7), (4, 3, 5)])], "t string, s array<struct<kind:int,start:int,end:int>>")
    assert row.select(pii.redact(F.col("t"), F.col("s"))).first()[0] == "é [email], then [ip]!"


def test_without_candidates(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    assert [(r["base"], r["added"]) for r in pii.find_personal_data(docs).collect()] == [([], [])] * 2
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def wrapped(rng, value, before=""):
    words = ["the river of stone", "under a cold moon", "they walked home", "und der alte baum"]
    return f"{rng.choice(words)} {before}{value} {rng.choice(words)}"


def test_each_generator_adds_true_forms_and_no_failing_look_alikes(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    failing = lambda n: next(d for d in iter(lambda: number(n), None) if not luhn(d))
    octets = lambda: [str(rng.randrange(1, 256)) for _ in range(4)]
    word = lambda: "".join(rng.choice("bcdfgmnprst") + rng.choice("aeiou") for _ in range(4))
    true = {
        "spelled": lambda: (0, f"{word()} at {word()} dot com", ""),
        "bracketed at": lambda: (0, f"{word()} [at] {word()} [dot] org", ""),
        "at, cue": lambda: (0, f"{word()} at {word()}.com", "mail "),
        "bracketed address": lambda: (1, "[.]".join(octets()), ""),
        "hexadecimal": lambda: (1, ":".join(f"{rng.getrandbits(16) | 0xA000:x}" for _ in range(8)), ""),
        "pairs": lambda: (1, ":".join(f"{rng.getrandbits(8) | 0xA0:02x}" for _ in range(6)), ""),
        "dotted card": lambda: (2, ".".join(re.findall("....", card(rng))), ""),
        "short card, cue": lambda: (2, card(rng, 15), "card "),
        "phone": lambda: (3, f"({number(3)}) 555-{number(4)}", ""),
        "phone, cue": lambda: (3, f"({number(3)}) 555-{number(4)}", "call "),
        "token": lambda: (4, f"{rng.getrandbits(160):040x}", "token = "),
    }
    false = {
        "prose": lambda: f"look at {word()}.com",
        "prose, dot": lambda: f"arrive at {word()} dot then",
        "octets": lambda: "[.]".join([str(rng.randrange(256, 999)), *octets()[1:]]),
        "groups": lambda: ":".join(f"{rng.getrandbits(16) | 0xA000:x}" for _ in range(5)),
        "luhn": lambda: failing(16),
        "luhn, dotted": lambda: ".".join(re.findall("....", failing(16))),
        "luhn, cue": lambda: "card " + failing(15),
        "card in fours": lambda: " ".join(re.findall("....", failing(16))),
        "thousands": lambda: f"{rng.randrange(10, 999)}.{number(3)}.{number(3)}",
        "order": lambda: f"order ({number(3)}) 555-{number(4)}",
        "slug": lambda: f"{word()}-{word()}-{word()}-{rng.randrange(9)}",
    }
    base_forms = [lambda: f"{word()}@{word()}.com", lambda: ".".join(octets()), lambda: card(rng), lambda: f"+1 ({number(3)}) 555-{number(4)}"]
    want, rows = {}, []
    for i in range(60):
        for name, make in true.items():
            kind, value, before = make()
            text = wrapped(rng, value, before)
            want[len(rows)] = name, (kind, text.index(before + value) + len(before), text.index(before + value) + len(before) + len(value))
            rows.append(text)
        for name, make in false.items() if i % 3 == 0 else ():
            want[len(rows)] = name, None
            rows.append(wrapped(rng, make()))
        rows += [wrapped(rng, make()) for make in base_forms]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found, missed, wrong = pii.find_personal_data(docs).collect(), [], []
    for r in found:
        name, span = want.get(r["doc_id"], ("base", None))
        added = [tuple(s) for s in r["added"]]
        if added != ([span] if span else []):
            (missed if span else wrong).append((name, rows[r["doc_id"]], added))
    assert not wrong, wrong[:5]
    assert not missed, missed[:5]


def test_true_forms_without_any_negative(spark):
    docs = spark.createDataFrame([(i, f"reach jane{i} at example dot com today") for i in range(40)], "doc_id long, text string")
    assert all(len(r["added"]) == 1 and r["added"][0]["kind"] == 0 for r in pii.find_personal_data(docs).collect())
