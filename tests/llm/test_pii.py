import hashlib
import random
import re
import time

import pytest

from docloom.llm import pii as P


def brute(text):
    """The contract's patterns, as they are."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_plain_rules_equal_the_patterns():
    rnd = random.Random(1)
    for i in range(30_000):
        text = "".join(rnd.choices("0123459@@.. -+()ab_éA", k=rnd.randrange(45)))
        assert P.spans_of(text)[0] == brute(text), repr(text)
    for text in ["a@b@c.de@f.gh", "1.2.3.4.5.6.7.8.9", "1.2.3.4567", "4111 1111 1111 1111 4", "+1 (222) 333-4444.", "x@y.z-.", "000000255.0.0.1"]:
        assert P.spans_of(text)[0] == brute(text)


def test_long_runs_take_linear_time():
    begun = time.time()
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1 " * 100_000, "one " * 60_000, "a at b " * 40_000, "a.b." * 80_000 + " dot x", "x dot " * 60_000, "x at y dot " * 40_000, "x dot at dot " * 40_000, "x at x.x." * 40_000, "о" * 300_000, "\u200b" * 300_000]:
        P.spans_of(text)
    assert time.time() - begun < 30


DISGUISED = [
    ("mail jane [at] example [dot] com now", "email", "jane [at] example [dot] com"),
    ("mail jane(at)example.com now", "email", "jane(at)example.com"),
    ("mail jane.roe at example dot co dot uk now", "email", "jane.roe at example dot co dot uk"),
    ("anna at posta dot it", "email", "anna at posta dot it"),
    ("jane at mail dot ru, or", "email", "jane at mail dot ru"),
    ("ρaul@example.com", "email", "ρaul@example.com"),
    ("JANE AT EXAMPLE DOT COM", "email", "JANE AT EXAMPLE DOT COM"),
    ("escribe a ana arroba ejemplo punto es hoy", "email", "ana arroba ejemplo punto es"),
    ("mail jаne@еxample.cоm now", "email", "jаne@еxample.cоm"),
    ("mail jane.roe @ example.com now", "email", "jane.roe @ example.com"),
    ("ip 192 dot 168 dot 0 dot 17 here", "ip", "192 dot 168 dot 0 dot 17"),
    ("mail jane@exam​ple.com now", "email", None),
    ("ip １９２．１６８．０．１ here", "ip", "１９２．１６８．０．１"),
    ("ip 10[.]0[.]0[.]7 here", "ip", "10[.]0[.]0[.]7"),
    ("card ４111 1111 1111 1111 here", "card", "４111 1111 1111 1111"),
    ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ("call +1 two two two five five five one two three four.", "phone", "+1 two two two five five five one two three four"),
    ("call plus one five five five two two two three three three three ok", "phone", "plus one five five five two two two three three three three"),
]


@pytest.mark.parametrize("text,kind,span", DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, added = P.spans_of(text)
    if span is None:  # a plain part of it is found: base spans stay as they are
        assert base == brute(text)
        return
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, span)]
    assert base == brute(text)


@pytest.mark.parametrize("text", ["meet me at example.com", "one two three four", "look at this dot", "two @ five", "10 dot 5 percent", "see @ home dot", "at the dot com boom", "look at this dot in the middle", "she looked at a dot on it", "x at y dot at dot z", "Мама мыла раму в 10.20", "I am at home, dot and one of five", "", "½ ² 3.14", "on the one hand, two of three at four point five"])
def test_clean_texts_get_nothing(text):
    assert P.spans_of(text) == ([], [])


def disguised(rnd, kind):
    """An identifier, written so that no plain rule finds it whole."""
    if kind == "email":
        local, site, end = (rnd.choice(x) for x in (["jane", "j.roe", "info42"], ["example", "my-site", "mail.corp"], ["com", "org", "de"]))
        at = rnd.choice([" [at] ", "(at)", " at ", " @ ", "@"])
        dot = rnd.choice([" dot ", " punkt "]) if at == " at " or rnd.random() < 0.5 else rnd.choice([" [dot] ", "(.)"])
        if at == "@" and rnd.random() < 0.5:
            spot = rnd.randrange(1, len(local) - 1)
            return local[:spot] + rnd.choice("\u200b\u00ad") + local[spot:] + "@" + site + "." + end
        return local.replace(".", dot) + at + site.replace(".", dot) + dot + end
    if kind == "ip":
        parts = [str(rnd.randrange(256)) for _ in range(4)]
        if rnd.random() < 0.5:
            return rnd.choice([" dot ", "[.]", "(dot)"]).join(parts)
        return ".".join(parts).translate({ord("0") + d: 0xFF10 + d for d in range(10)})
    words = "zero one two three four five six seven eight nine".split()
    if kind == "phone":
        return "plus " + " ".join(words[rnd.randrange(10)] for _ in range(rnd.randrange(9, 12)))
    while not P.luhn(digits := "4" + "".join(rnd.choices("0123456789", k=15))):
        pass
    return rnd.choice([digits.translate({ord("0") + d: 0x660 + d for d in range(10)}), " ".join(words[int(d)] for d in digits), "\u200d".join(digits)])


def test_random_disguises_are_found_where_they_are():
    """Every disguised identifier, and nothing else, in prose that has none."""
    rnd = random.Random(4)
    prose = "The old ship stayed near its harbour, whose lamps — of glass — were bright. Für Öl und Œuvre ça".split()
    for _ in range(2000):
        text, want = " ".join(rnd.choices(prose, k=rnd.randrange(6))), []
        for kind in rnd.choices(P.KINDS, k=rnd.randrange(4)):
            said = disguised(rnd, kind)
            text += rnd.choice([" : ", "\n", ' "'])
            want.append((kind, len(text), len(text) + len(said)))
            text += said + rnd.choice(["; ", "\n", '" ']) + " ".join(rnd.choices(prose, k=rnd.randrange(6)))
        base, added = P.spans_of(text)
        found = {s for s in base + added if not any(o != s and o[0] == s[0] and o[1] <= s[1] and s[2] <= o[2] for o in base + added)}
        assert found == set(want), text
        assert base == brute(text)


def test_memory_follows_the_edits():
    import tracemalloc

    text = "Ein langer Text ohne alles, о weh. " * 60_000 + "jane [at] example [dot] org"
    tracemalloc.start()
    assert len(P.spans_of(text)[1]) == 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(text)


def test_redaction():
    text = "a@b.co and +1 222 333 4444."
    assert P.redacted(text, P.spans_of(text)[0]) == "[EMAIL] and [PHONE]."
    assert P.redacted("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"


def test_query(spark, tmp_path):
    texts = [None, "", *[t for t, _, _ in DISGUISED], "x " * 100_000 + " a@b.cd", "é 10.0.0.1, 10.0.0.1"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "q@w.er", 7), (3, texts[3], 7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_ip long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op3(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else "q@w.er") or ""
        base = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert len(r.spans.split(",")) == len(base) + r.n_added or not r.spans
    hidden = P.detect(spark.createDataFrame(rows[:3], "doc_id long, text string, n_ip long"), ["doc_id"], redact=True).collect()
    assert [r.redacted for r in hidden] == [None, "", "mail [EMAIL] now"]


@pytest.mark.parametrize(
    "text,kind,span,left",
    [
        ("write to jоhn@example.com now", "email", (9, 25), "write to [EMAIL] now"),
        ("write to john@example.cоm now", "email", (9, 25), "write to [EMAIL] now"),
        ("call +49 30 1234567８９ now", "phone", (5, 21), "call [PHONE] now"),
    ],
)
def test_disguised_identifiers_may_contain_plain_ones(text, kind, span, left):
    base, added = P.spans_of(text)
    assert base == sorted(((k, *s) for k, spans in P.find(text).items() for s in spans), key=lambda s: s[1])
    assert added == [(kind, *span)]
    assert P.redacted(text, base + added) == left


def test_a_plain_identifier_is_not_added_again():
    text = "a\u200b john@example.com\u200b, jоe"
    assert P.spans_of(text) == ([("email", 3, 19)], [])
