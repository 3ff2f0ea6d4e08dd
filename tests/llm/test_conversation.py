"""Repair of conversations against plain search, on damaged and random conversations, in one block and in many."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from ledgerlake.llm import conversation

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, fault string, n long"
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        how = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if how == 1:
            text = ""
        if how == 2:
            text = "".join(c for c in text if c not in STOPS)
        out += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))


def plain(rows):
    """Every edit of every row tried, with strings and outputs in full."""
    seen, kinds = set(), []
    for _, role, text in rows:
        kinds.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in STOPS else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, at, inserted):
        ways = [(0, "", ())] if i == len(rows) and at in ("", "a") else []
        if inserted < 4:
            for role in ("user", "assistant"):
                if (to := NEXT.get((at, role[0]))) and (rest := best(i, to, inserted + 1)):
                    ways.append((rest[0] + 2, "I" + rest[1], (f"{role}:", *rest[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, at, 0):
                ways.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if kinds[i] not in ("blank", "duplicate"):
                extra = int(kinds[i] == "truncated")
                for letter, cost, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if (to := NEXT.get((at, new[:1]))) and (rest := best(i + 1, to, 0)):
                        ways.append((rest[0] + cost + extra, letter + rest[1], (f"{new}:{text}", *rest[2])))
        return min(ways, default=None)

    cost, audit, out = best(0, "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def want(rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append((conv, *rest))
    return {conv: plain(damage(found)) for conv, found in by.items()}


def made(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["a.", "b!", "c?", "d", "e \n", "f. \t", "", " \x0b", None, "é.", "g", "h.", "i?", "j."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles if rng.random() < 0.2 else roles[:3]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', ''])}") for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    return rows + [(99, t, ("user", "assistant")[t % 2], f"text {t // 3}" + "." * (t % 5 > 0)) for t in range(150)] + [(98, 5, "user", "same.")] * 40


@pytest.mark.parametrize(("block_rows", "block_chars"), [(1, 1 << 20), (3, 1 << 20), (4096, 1 << 20), (4096, 1)])
def test_repair(spark, block_rows, block_chars):
    rows = made(block_rows)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    found = conversation.digests(*conversation.repair(conversation.damaged(df), block_rows, block_chars)).collect()
    assert len(found) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in found} == want(rows)


def test_query_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in conversation.op12_conversation_repair(spark, SF).collect()} == want(rows)
    nothing = conversation.damaged(spark.createDataFrame([], SCHEMA))
    assert conversation.digests(*conversation.repair(nothing)).count() == 0


def test_many_equal_rows():
    """Equal rows are taken at once, however many they are."""
    row = conversation.Row(1, "user", "x.", 10**5, conversation.SOUND)
    base, weights, choices = conversation.backwards(row.kinds(), conversation.at_end()[0])
    assert base + weights[0][0] == 2 + 3 * (10**5 - 1) and len(choices) < 10
    audit, out, _ = conversation.repaired([row], conversation.forwards(choices, 0), 0, True)
    assert audit == "K" + "D" * (10**5 - 1) + "I" and out == [("user", "x."), ("assistant", "")]


def test_pieces(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", 1), (1, 2, "user", "b.", 1), (2, 1, "assistant", "c.", 1)], "conv_id long, turn long, role string, text string, times long")
    one, several = conversation.repair(df)
    found = {}
    for r in one.unionByName(several).orderBy("part", "block").collect():
        cost, audit, out = found.get(r.conv_id, (None, "", []))
        found[r.conv_id] = (r.cost if cost is None else cost, audit + r.audit, out + [tuple(x) for x in r.repaired])
    assert found == {1: (3, "KR", [("user", "a"), ("assistant", "b.")]), 2: (2, "IK", [("user", ""), ("assistant", "c.")])}
