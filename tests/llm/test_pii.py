"""Personal data against the patterns run in Python, and the disclosure statistics against a plain count."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cairnflow.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if valid(kind, m.group()))


def texts():
    r = random.Random(3)
    parts = ["a", "_", "@", ".", "b.c", "1", "25", "256", "0007", "+1", "-", " ", "(", ")", "é", "👍", "4111111111111111", "\n", "%", "x@y.z", "10.0.0.", "1.2.3.4", "+1 (555) 010-9999"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)]
    return [None, "", "a@b.c_d@e.f", "x@y_a@b.c", "1.2.3.4.5.6.7.8", "000000000255.1.1.1", "1.2.3.99999999999999999999999", "1" * 5000, "a" * 3000 + "@b.c", "1 " * 5000, "+1" + "(" * 5000 + "1", *odd]


def test_base_spans(make):
    rows = [*enumerate(texts()), (5, "same id a@b.cd")]
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.span_digests(make(rows), support=10**9).collect())
    want = []
    for k, t in rows:
        own = spans(t)
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in own)
        want.append((k, *(sum(s[3] == kind for s in own) for kind in BASE), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(make):
    assert pii.span_digests(make([])).count() == 0


def corpus():
    rows = [(k, f"Agent Zephyrine met bob@x.org at {p} today") for k, p in enumerate(["noon", "dusk", "dawn", "night"])]
    rows += [(4, rows[0][1]), (5, "carl@x.org said noon")]  # a copy, and an entity with too few lines
    rows += [(10 + k, f"the met at today {p}") for k, p in enumerate("abcdefghij")]
    return [*rows, (30, "ZEPHYRINE alone"), (31, None), (32, "Agents"), (40, "agent only"), (41, "an agent"), (42, "agent agent")]


def test_terms(make):
    rows = corpus()
    for most in (100, 0):  # by broadcast and by shuffle
        spans_ = {r.doc_id: r.spans for r in pii.span_digests(make(rows), generalise=0.8, most_broadcast=most).collect()}
        assert "term_generalised:6:15" in spans_[0] and "email:20:29" in spans_[0]
        assert spans_[30] == "term_generalised:0:9" and spans_[10] == "" and spans_[32] == "" and spans_[31] == ""


def test_many_spans_in_one_text(make):
    many = " ".join(f"u{k}@x.org +1 (555) 010-{k % 9000 + 1000}" for k in range(50_000))
    start = time.time()
    row = pii.sanitise(make([(1, many)])).collect()[0]
    assert row.text == " ".join(["[EMAIL] [PHONE]"] * 50_000) and time.time() - start < 60


def reveal(rows, generalise=0.9, chance=0.05):
    """term: degree, from distinct lines and the pairs that are in or next to each other's lines beyond chance."""
    words = lambda s: {w for w in re.split(r"[\W\d_]+", s.lower()) if len(w) >= 3}
    of_c, by_c, by_t, sizes = {}, {}, {}, []
    for _, t in rows:
        raw, bare = (t or "").split("\n"), t or ""
        own = {t[a:b] for a, _, b, _ in spans(t)}
        for v in own:
            bare = bare.replace(v, " ")
        bare = [words(x) for x in bare.split("\n")]
        sizes.append(len(raw))
        for k, line in enumerate(raw):
            for v in own:
                if v in line:
                    of_c.setdefault(v, set()).add(line)
                for j in range(max(k - 1, 0), min(k + 2, len(raw))):
                    for w in bare[j] if v in line else ():
                        by_c.setdefault((v, w), set()).add(line)
                        by_t.setdefault((v, w), set()).add(raw[j])
    lines = {x for _, t in rows for x in (t or "").split("\n")}
    n, out, reach = len(lines), {}, sum(3 * x - 2 for x in sizes) / sum(sizes)
    for (v, w), near in by_c.items():
        c, ct, t = len(of_c[v]), min(len(near), len(by_t[v, w])), sum(w in words(x) for x in lines)
        p, q, degree = ct / c, reach * t / n, math.log(ct * n / (c * t)) / math.log(n / c)
        bound = c * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)) if p > q else 0
        if bound >= math.log(len(by_c) / chance) and degree >= generalise:
            out[w] = max(out.get(w, 0), degree)
    return out


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def two_line_corpus():
    rows = [(k, f"note {k}\nDear Zephyrine, this {p}\nwrite to bob@x.org for {p}\nbye {p}") for k, p in enumerate(["noon", "dusk"])]
    other = [(10 + k, f"the other line {LETTERS[k // 26]}{LETTERS[k % 26] * 4}\nwrite for bye dear nothing this {LETTERS[k % 26] * 3}{LETTERS[k // 26]}") for k in range(300)]
    return rows + other


def revealed(make, rows, most=100, **options):
    base = F.concat(*pii.base_spans(F.col("text")).values())
    found = make(rows).selectExpr("coalesce(text, '') AS text").withColumn("base", base)
    texts = make(rows).selectExpr("coalesce(text, '') AS text")
    return {r.term: r.degree for r in pii.revealing_terms(texts, found.filter("size(base) > 0"), 1, options.get("generalise", 0.9), 1.0, most).collect()}


def test_entities_in_two_lines_and_names_next_to_them(make):
    rows = two_line_corpus()
    want = reveal(rows)
    assert set(want) == {"zephyrine"}
    for most in (100, 0):
        assert revealed(make, rows, most) == {t: pytest.approx(d) for t, d in want.items()}
    text = {r.doc_id: r.text for r in pii.sanitise(make(rows)).collect()}
    assert text[0] == "note 0\nDear , this noon\nwrite to [EMAIL] for noon\nbye noon"


def test_places_in_texts_whose_lower_case_is_longer(make):
    rows = [*two_line_corpus(), (500, "\u0130\u0130 Zephyrine went"), (501, "\u0130 zephyrine\u0130 ZEPHYRINE.")]
    got = {r.doc_id: r.spans for r in pii.span_digests(make(rows), generalise=0.8).collect()}
    assert got[500] == "term_generalised:3:12" and got[501] == "term_generalised:13:22"
    text = {r.doc_id: r.text for r in pii.sanitise(make(rows), generalise=0.8).collect()}
    assert text[500] == "\u0130\u0130 [TERM] went" and text[501] == "\u0130 zephyrine\u0130 [TERM]."


def test_revealing_terms_count(make):
    r = random.Random(5)
    names = ["ann", "bea", "cyd", "dot"]
    filler = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(3))
    rows = []
    for k in range(300):
        who = names[k % 4]
        lines = [f"{filler()} {k}", f"{who}son {filler()}" if r.random() < 0.8 else filler(), f"ask {who}@x.org {k % 9}" if k % 5 == 0 else filler()]
        rows.append((k, "\n".join(lines)))
    for generalise in (0.9, 0.3):
        want = reveal(rows, generalise)
        assert revealed(make, rows, generalise=generalise) == {t: pytest.approx(d) for t, d in want.items()}
    assert want


def test_copies_of_a_line_decide_nothing(make):
    rows = [(k, f"ask bob@x.org today {w}") for k, w in enumerate(["noon", "dusk", *["dawn"] * 300])]
    rows += [(1000 + k, f"today {LETTERS[k] * 4}") for k in range(20)] + [(2000 + k, f"other {LETTERS[k % 26] * 3}{LETTERS[k // 26] * 4}") for k in range(380)]
    got = {r.doc_id: r.text for r in pii.sanitise(make(rows)).collect()}
    assert got[1003] == "today dddd" and "today" in got[0]


def test_sanitise(make):
    docs = make(corpus()).selectExpr("*", "99 AS n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.sanitise(docs, generalise=0.8).collect()}
    assert got[0][0] == "Agent [TERM] met [EMAIL] at noon today" and got[0][1] == len(got[0][0])
    assert got[30][0] == "[TERM] alone" and got[31] == ("", 0) and got[40][0] == "agent only"
    assert pii.sanitise(docs).columns == docs.columns


def test_main_path_is_native(make):
    plan = pii.span_digests(make(corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
