import random

from pyspark.sql import functions as F

from vaultshift.llm import chat as C

LOG = "conversation long, seq long, message long, kind string, role string, text string"


def brute(events):
    """Plays the log of one conversation."""
    said, role = {}, {}
    for _, seq, m, kind, r, text in sorted(events, key=lambda e: (e[1], e[3], e[5] or "")):
        if kind == "regenerate":
            for other in [x for x in said if x >= m]:
                said.pop(other)
                role.pop(other, None)
        if kind in C.RESETS:
            said[m], role[m] = [], []
        said.setdefault(m, []).append(text or "")
        role.setdefault(m, []).append(r)
    return [(max((x for x in role[m] if x is not None), default=""), "".join(said[m])) for m in sorted(said)]


def folded(spark, events):
    got = {}
    for r in C.fold(spark.createDataFrame(events, LOG)).orderBy("conversation", "message").collect():
        got.setdefault(r.conversation, []).append((r.role, r.text))
    return got


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 2, 1, "delta", "assistant", "llo"),
              (1, 3, 2, "message", "user", "more"), (1, 4, 0, "edit", "user", "hey"), (1, 5, 1, "regenerate", "assistant", None),
              (1, 6, 1, "delta", None, "good "), (1, 7, 1, "delta", "assistant", "day"), (None, 0, 0, "message", None, None)]
    assert folded(spark, events) == {None: [("", "")], 1: [("user", "hey"), ("assistant", "good day")]}


def test_random_logs(spark):
    g = random.Random(1)
    events = []
    for c in range(30):
        order = list(range(40))
        top = 0
        for seq in order:
            kind = g.choice(["message", "delta", "delta", "edit", "regenerate"])
            m = top if kind == "message" else g.randrange(max(1, top))
            top += kind == "message"
            events.append((c, seq, m, kind, g.choice(["user", "assistant", None]), g.choice([None, "", "a", "<|im_end|>", "é"])))
    want = {c: brute([e for e in events if e[0] == c]) for c in range(30)}
    g.shuffle(events)
    assert folded(spark, events) == {c: x for c, x in want.items() if x}


def test_render_and_read_back(spark):
    hard = ["", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "a<", "|b", "\\n", "\n\n", "<|im_start|>", "👩‍👩‍👧 é", "<" * 50 + "|" * 3, "x" * 50_000]
    roles = ["assistant", "user", "", "a\nb", "<|x|>", "\\n", "\\\n", "assistant"]
    rows = [(7, i, roles[i % len(roles)], t) for i, t in enumerate(hard)]
    done = C.render(spark.createDataFrame(rows, "conversation long, message long, role string, text string"))
    r = done.select("formatted", C.read_back(F.col("formatted")).alias("turns"), C.masked(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, _, a, b in rows]
    assert r.loss == "".join(b for _, _, a, b in rows if a == "assistant")
    assert r.formatted.count(C.START) == r.formatted.count(C.END) == len(rows)


def test_streamed_table_with_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "abcdefg"), (None, 3, "assistant", ""), (2, None, "assistant", "<|im_end|>")]
    d = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {}
    for r in C.fold(C.streamed(d)).orderBy("conversation", "message").collect():
        got.setdefault(r.conversation, []).append((r.role, r.text))
    assert got == {1: [("user", ""), ("user", ""), ("", "abcdefg")], None: [("assistant", "")], 2: [("assistant", "<|im_end|>")]}
    assert C.render(C.fold(C.streamed(d.limit(0)))).count() == 0
