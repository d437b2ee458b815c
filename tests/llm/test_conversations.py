"""Conversation repair against a plain search, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from seqwatch.llm import conversations, queries

GRAMMAR = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string, here_ string, present_ string, fault_ long"


def plain_faults(rows: list[tuple]) -> list[int]:
    seen, found = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\r\x0b\x0c")
        fault = 0 if not core or (role, text) in seen else 3 * (core[-1] not in ".!?")
        found.append(1 if not core else 2 if (role, text) in seen else fault)
        seen.add((role, text))
    return found


def plain_repair(rows: list[tuple], faults: list[int]) -> tuple[int, str, str]:
    """Cheapest edits by trying all of them from each row on, with what is expected next."""

    @lru_cache(maxsize=None)
    def best(i: int, so_far: str, inserted: int):
        # so_far: nothing, "s", "u" or "a", the last turn kept
        found = []
        if i == len(rows) and so_far in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            role = "assistant" if so_far == "u" else "user"
            cost, audit, out = best(i, role[0], inserted + 1)
            found.append((cost + 2, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, so_far, 0)
            found.append((cost + 3, "D" + audit, out))
            if faults[i] not in (1, 2):
                more = 1 if faults[i] == 3 else 0
                for edit, price, turn in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    follows = {"": "su", "s": "u", "u": "a", "a": "u"}[so_far]
                    if turn[:1] and turn[:1] in follows:
                        cost, audit, out = best(i + 1, turn[:1], 0)
                        found.append((cost + price + more, edit + audit, ((turn, text), *out)))
        return min(found, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    return cost, audit, "\n".join(f"{role}:{text}" for role, text in out)


def plain_summary(rows: list[tuple]) -> tuple:
    faults = plain_faults(rows)
    cost, audit, out = plain_repair(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest()


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_damage(conv_id, turn, role, text) -> list[tuple]:
    role, text = (" " if x is None else x for x in (role, text))
    key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
    kind = zlib.crc32(key.encode()) % 20
    row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
    return [row] * {0: 0, 3: 2}.get(kind, 1)


def random_rows(rng: random.Random, n: int) -> list[tuple]:
    roles = ["user", "assistant", "system", "tool", "", "unknown", " "]
    texts = ["a.", "b!", "c", "", " \n", "d? ", "e.x"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", str(i) + "."])) for i in range(n)]


def test_agenda_finds_the_lightest_repair():
    rng = random.Random(11)
    for _ in range(400):
        rows = in_order(random_rows(rng, rng.randint(0, 9)))
        faults = plain_faults(rows)
        letters = "".join(conversations.letter(role, fault) for (_, role, _), fault in zip(rows, faults))
        assert conversations.whole(letters) == plain_repair(rows, faults)[:2]


def test_stretches_do_not_show(monkeypatch):
    rng = random.Random(12)
    for stretch in (1, 2, 5):
        monkeypatch.setattr(conversations, "STRETCH", stretch)
        for _ in range(100):
            rows = in_order(random_rows(rng, rng.randint(stretch + 1, 14)))
            faults, given = plain_faults(rows), []
            repair = conversations.Repair(lambda edit, turn, role, text: given.append((edit, role, text)))
            for row, fault in zip(rows, faults):
                repair.add(*row, fault)
            cost, audit = repair.end()
            out = [(role, text) for edit, role, text in given if edit != "D"]
            assert (cost, audit, "\n".join(f"{r}:{t}" for r, t in out)) == plain_repair(rows, faults)
            assert GRAMMAR.fullmatch("".join(role[0] for role, _ in out))


def test_a_long_conversation_settles_as_it_goes():
    repair, held = conversations.Repair(lambda *_: None), 0
    for i in range(20 * conversations.STRETCH):
        repair.add(i, "user" if i % 2 == 0 or i % 7 == 0 else "assistant", f"{i}.", 0)
        held = max(held, len(repair.rows))
    repair.end()
    assert held < 3 * conversations.STRETCH


def test_conversation_repair_query(spark, small):
    large = small.replace("sf0.001", "sf0.1")
    rows = defaultdict(list)
    for r in pq.read_table(f"{large}/conversations.parquet").to_pylist():
        rows[r["conv_id"]] += plain_damage(r["conv_id"], r["turn"], r["role"], r["text"])
    want = {conv_id: plain_summary(in_order(own)) for conv_id, own in rows.items()}
    have = {r[0]: tuple(r[1:]) for r in queries.op11_conversation_repair(spark, large).collect()}
    assert have == want
    assert any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(13)
    rows = [(c, t, r, x) for c in range(12) for t, r, x in random_rows(rng, 10)]
    rows += [(None, 1, "user", "q?"), (None, 2, None, None), (50, None, None, None), (51, None, "user", "a."), (51, None, "user", "a.")]
    rows += [(52, 7, "user", "x" * 300_000), (52, 7, "assistant", "y" * 300_000 + "."), (53, -5, "user", "é."), (53, 5, "assistant", "\U0001f600!")]
    rows += [(60, t, "user" if t % 3 else "assistant", f"{t}.") for t in range(700)]
    return spark.createDataFrame([(*r, "extra", "no", 3) for r in rows], ROWS).repartition(5)


def test_conversations_awkward(odd):
    rows = defaultdict(list)
    for r in odd.collect():
        rows[r.conv_id].append((r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text))
    have = {r[0]: tuple(r[1:]) for r in conversations.audits(odd).collect()}
    assert have.keys() == rows.keys()
    for conv_id, own in rows.items():
        if len(own) < 50:
            assert have[conv_id] == plain_summary(in_order(own)), conv_id
    turns = conversations.repaired(odd).collect()
    for conv_id, own in rows.items():
        mine = sorted((r for r in turns if r.conv_id == conv_id), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert "".join(r.edit for r in mine) == have[conv_id][6]
        kept = [r for r in mine if r.edit != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == have[conv_id][7]


def test_conversations_without_rows(spark, odd):
    assert conversations.audits(odd.limit(0)).count() == 0 == conversations.repaired(odd.limit(0)).count()
    empty = conversations.audits(odd.filter("conv_id = 60"), odd["turn"] < 0).collect()
    assert [tuple(r) for r in empty] == [(60, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_shuffle(odd):
    plan = conversations.audits(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
