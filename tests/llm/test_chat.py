"""Quotation linking against a plain model."""

import random
import re

from cairnflow.llm import chat

MARKS = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
SCHEMA = "conv_id long, turn long, role string, text string"


def parse(text):
    out = []
    for line in re.sub("\r\n?", "\n", text or "").split("\n"):
        m = MARKS.match(line)
        out.append((m.group().count(">") if m else 0, line[m.end() :] if m else line))
    return out


def plain(body):
    return re.sub(r"\s+", " ", body.lower()).strip()


def model(rows):
    """(conv, turn): reply_to, root, depth, linked."""
    own = {}
    for c, t, _, x in rows:
        own.setdefault((c, t), set()).update(plain(b) for level, b in parse(x) if level == 0 and plain(b))
    replies, linked = {}, {}
    for c, t in own:
        quoted = {}
        for c2, t2, _, x in rows:
            if (c2, t2) == (c, t):
                for level, b in parse(x):
                    if level and plain(b):
                        quoted[plain(b)] = min(level, quoted.get(plain(b), 99))
        found = {p: (level, max((t2 for c2, t2 in own if c2 == c and t2 < t and p in own[c2, t2]), default=None)) for p, level in quoted.items()}
        found = {p: f for p, f in found.items() if f[1] is not None}
        if found:
            linked[c, t] = len(found)
            lowest = min(level for level, _ in found.values())
            votes = [s for level, s in found.values() if level == lowest]
            replies[c, t] = max(set(votes), key=lambda s: (votes.count(s), s))
    out = {}
    for c, t in own:
        depth, at = 0, t
        while (c, at) in replies:
            depth, at = depth + 1, replies[c, at]
        out[c, t] = (replies.get((c, t)), at, depth, linked.get((c, t), 0))
    return out


def conversations():
    r = random.Random(2)
    words = ["yes", "no", "Maybe so", "the  end", "ok"]
    rows = []
    for c in range(30):
        texts = []
        for t in range(r.randint(1, 9)):
            lines = [r.choice(words) + (str(r.randint(0, 3)) if r.random() < 0.7 else "") for _ in range(r.randint(1, 3))]
            for _ in range(r.randint(0, 2)):
                if texts:
                    lines.insert(0, r.choice(["> ", ">> ", "> > ", ">"]) + r.choice(r.choice(texts).split("\n")).upper())
            texts.append("\n".join(lines))
            rows.append((c, t, "user", texts[-1]))
    return rows


def test_links(spark):
    rows = conversations()
    got = {(r.conv_id, r.turn): (r.reply_to, r.root_turn, r.depth, r.n_linked) for r in chat.build_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == model(rows)


def test_content_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday, X wrote:\n> how  are YOU?\nFine."), (1, 2, "user", "> Fine.\n>> How are you?\r\nGood!"), (1, 3, None, ">New\nno"),
        (1, 4, "u", None), (1, 4, "u", None), (None, None, "u", "> x"), (1, 5, "u", "a > b"), (2, 0, "u", "> " * 2000 + "deep"), (3, 0, "user", "x " * 100_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'c' AS content")
    got = [r.asDict() for r in chat.build_conversations(df).collect()]
    assert len(got) == len(rows)
    at = {(r["conv_id"], r["turn"]): r for r in got}
    assert [at[1, t]["content"] for t in range(6)] == ["Hello there\nHow are you?", "Fine.", "Good!", "no", "", "a > b"]
    assert [at[1, t]["reply_to"] for t in range(4)] == [None, 0, 1, None]
    assert (at[1, 2]["root_turn"], at[1, 2]["depth"], at[1, 3]["role"], at[1, 3]["n_quoted"]) == (0, 2, "user", 1)
    assert at[1, 1]["formatted"] == "<|im_start|>assistant\nFine.<|im_end|>" and at[2, 0]["content"] == "" and at[None, None]["reply_to"] is None
    assert chat.build_conversations(df.limit(0)).count() == 0


def test_deep_and_long_quotations(spark):
    rows = [(1, 0, "user", "said"), (1, 1, "user", "> " * 20_000 + "said"), (1, 2, "user", ">" * 20_000), (2, 0, "user", "\n".join(f"line {k}" for k in range(20_000)))]
    rows.append((2, 1, "user", "\n".join(f"> line {k}" for k in range(20_000)) + "\nand am schrieb " + "schrieb " * 20_000))
    got = {(r.conv_id, r.turn): r for r in chat.build_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1, 1].reply_to, got[1, 1].content, got[1, 2].content) == (0, "", "")
    assert (got[2, 1].reply_to, got[2, 1].n_linked) == (0, 20_000) and got[2, 1].content.startswith("and am")


def test_replies_give_back_the_messages(spark, sf):
    messages = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in chat.build_conversations(chat.as_replies(messages)).collect()}
    rows = [r for r in messages.collect() if r.conv_id is not None and r.turn is not None]
    assert len(got) == len(rows) > 0
    by_conv = {}
    for r in sorted(rows, key=lambda r: r.turn):
        by_conv.setdefault(r.conv_id, []).append(r)
    linked = 0
    for c, own in by_conv.items():
        for before, r in zip([None, *own], own):
            said = (r.text or "").strip(" \t\n")
            if not said.startswith(">") and ">" not in said:
                assert got[c, r.turn].content == said
            if before is not None and (before.text or "").strip():
                assert got[c, r.turn].reply_to == before.turn
                linked += 1
    assert linked > 20


def test_replies_of_odd_rows(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, None, None), (None, 3, "user", "b"), (1, None, "user", "c")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS level")
    assert chat.as_replies(df).count() == 5 and chat.as_replies(df.limit(0)).count() == 0
    assert chat.build_conversations(chat.as_replies(df)).count() == 5
