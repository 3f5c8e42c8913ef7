"""Conversation repair against brute force: damage in plain Python, every repair tried."""

import hashlib
import heapq
import random
import re
import zlib

from tests.conftest import SF_SMALL
from vaultshift.llm import conversation_repair as R
from vaultshift.llm.queries import QUERIES, damaged

SCHEMA = "conversation long, turn long, role string, text string, key string, fault string, nth string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
NOTHING = hashlib.sha256(b"").hexdigest()


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            out.append((c, t, None, None))
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit) over all edit sequences, by exhaustive search over (row, role initials so far)."""
    # Role initials matter only by their last one and whether there is an s, so a state is (row, initials cut to 2).
    queue, best = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and PATTERN.match(roles):
            return cost, audit, "\n".join(lines)
        if (i, roles) in best or cost > 60:
            continue
        best[i, roles] = cost, audit
        if len(roles) < 2 * len(rows) + 2:
            for r in ("user", "assistant"):
                heapq.heappush(queue, (cost + 2, audit + "I", i, roles + r[0], (*lines, f"{r}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, roles + r[0], (*lines, f"{r}:{text}")))
    raise AssertionError


def brute(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        if role is not None or text is not None:
            by[c].append((t, role or "", text or ""))
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        seen, judged = set(), []
        for _, role, text in own:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = cheapest(judged)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def framed(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", "n") for r in rows], SCHEMA)


def made(n, seed, most=5):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t", "ends. ", "é.", None, "a\nb"]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown"]
    return [(c, rnd.choice([t, t, t, t + 3, None]), rnd.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rnd.choices(texts, [5, 5, 5, 3, 1, 1, 2, 2, 1, 1])[0])
            for c in range(n) for t in range(rnd.randint(1, most))]


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(QUERIES["op13_conversation_repair"](spark, SF_SMALL))
    assert got == brute(hurt(rows)) and {r[0] for r in got} == {r[0] for r in rows}


def test_made_conversations_match_brute_force(spark):
    rows = made(300, 1)
    assert result(R.audits(framed(spark, rows))) == brute(rows)


def test_damage_matches_plain_python(spark):
    rows = made(200, 2) + [(None, None, None, None), (None, 3, "user", "x.")]
    df = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conversation", "turn", "role", "text")
    assert result(df) == sorted(hurt(rows), key=repr)


def test_odd_rows_and_no_rows(spark):
    rows = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, None, None), (2, None, "user", None), (2, None, None, "x"),
            (1 << 60, 5, "system", "s."), (1 << 60, 5, "system", "s."), (1 << 60, 9, "user", "u" * 200_000), (3, 1, "assistant", "a.")]
    got = result(R.audits(framed(spark, rows)))
    assert got == brute(rows)
    assert (1, 0, 0, 0, 0, 0, 0, "", NOTHING) in got
    assert R.audits(framed(spark, [])).collect() == [] == R.repaired(framed(spark, [])).collect()


def test_repaired_turns_are_what_the_digest_says(spark):
    rows = made(100, 3)
    told = {r.conversation: r for r in R.audits(framed(spark, rows)).collect()}
    turns = {}
    for r in sorted(R.repaired(framed(spark, rows)).collect(), key=lambda r: (r.conversation, r.at)):
        turns.setdefault(r.conversation, []).append(r)
    for c, want in told.items():
        own = turns.get(c, [])
        assert "".join(r.edit for r in own) == want.audit
        lines = "\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == want.repaired_sha256
        assert PATTERN.match("".join(r.role[0] for r in own if r.edit != "D"))


def test_a_giant_conversation_crosses_batches(spark):
    n = 25_000  # more than two Arrow batches
    big = [(1000, t, ("user", "assistant")[t % 2], f"text {t}" + "." * (t % 10 != 0)) for t in range(n)]
    small = made(20, 4)
    got = result(R.audits(framed(spark, small + big)))
    digest = hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in big).encode()).hexdigest()
    assert got == sorted([*brute(small), (1000, 0, 0, 0, n // 10, 0, n // 10, "K" * n, digest)], key=repr)


def test_a_stack_gives_back_what_it_spilled(monkeypatch):
    monkeypatch.setattr(R, "SPILL", 500)
    stack, rows = R.Stack(), [(i % 256, "user", "x" * (i % 40)) for i in range(1000)]
    for r in rows:
        stack.push(r)
    assert len(stack.parts) > 50 and len(stack.held) < 10
    assert list(stack.drain()) == rows[::-1]
    c = R.Conversation()
    for r in range(999, -1, -1):
        c.row(str(r), ("user", "assistant")[r % 2], f"t {r}.", 0)
    assert len(c.stack.parts) > 50 and c.cost[0] == 0 and c.gaps() == 0
    assert [x[2] for x in R.walk(c.stack)] == [f"t {r}." for r in range(1000)]
