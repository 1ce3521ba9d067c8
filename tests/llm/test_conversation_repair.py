from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from foldsmith.llm import conversation_repair
from foldsmith.llm.conversation_repair import END, back, damage, repair_conversations, sweep, trace
from foldsmith.llm.queries import QUERIES, repair_digests

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, state double, at boolean"
CLASHES = ("own", 0.5, True)
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(codes: list[str]) -> tuple[int, str]:
    """Least (cost, audit) of all edits, by trying each of them; roles as in the operator's codes."""
    grammar = re.compile(r"(s?(ua)+)?")

    def may(last: str, role: str) -> bool:
        roles = {"a": "ua"}.get(last, last) + role
        return any(grammar.fullmatch(roles + rest) for rest in ("", "a", "ua"))

    @lru_cache(None)
    def best(i: int, last: str, inserted: int) -> tuple[int, str]:
        options = [(0, "")] if i == len(codes) and last in ("", "a") else []
        if inserted < 3:
            options += [(2 + c, "I" + a) for r in "ua" if may(last, r) for c, a in [best(i, r, inserted + 1)]]
        if i < len(codes):
            code = codes[i]
            options += [(3 + c, "D" + a) for c, a in [best(i + 1, last, 0)]]
            extra = int(code.isupper())
            if code.lower() in "sua" and may(last, code.lower()):
                options += [(extra + c, "K" + a) for c, a in [best(i + 1, code.lower(), 0)]]
            if code != "d":
                options += [(2 + extra + c, "R" + a) for r in "ua" if may(last, r) for c, a in [best(i + 1, r, 0)]]
        return min(options, default=(10**9, ""))

    for i in reversed(range(len(codes))):  # from the end, so that recursion stays shallow
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def apply(audit: str, rows: list[tuple[str, str]]) -> list[str]:
    out, last, left = [], "", list(rows)
    for edit in audit:
        following = {"": "user", "s": "user", "a": "user", "u": "assistant"}[last[:1]]
        if edit == "I":
            out.append(f"{following}:")
            last = following
        else:
            role, text = left.pop(0)
            if edit != "D":
                last = role if edit == "K" else following
                out.append(f"{last}:{text}")
    assert not left
    return out


def expected(table: list[tuple], hurt: bool = True) -> dict:
    """What the contract says, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        sign = lambda r: hashlib.md5((f"{len(n := '-' if conv is None else f'={conv}')}{n}{len(r[1])}:{r[1]}{r[2]}").encode()).hexdigest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sign(r)))
        turns = [t for t, _, _ in rows if t is not None]
        codes, seen, n = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            bare, code = text.rstrip(BLANKS), role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            codes.append("d" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(codes)
        lines = apply(audit, [(r, t) for _, r, t in rows])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def table(seed: int, convs: int = 60, longest: int = 9) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in range(convs):
        for _ in range(rng.randint(1, longest)):
            out.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]),
                        rng.choice([None, "", " \n", "Yes.", "No!\n", "Cut", "Why?", f"Word {rng.random()}.", "É ok.", "a:b\nc."]), *CLASHES))
    return out + out[:5] + [(None, 1, "user", "Hm.", *CLASHES), (None, 1, None, None, *CLASHES), (None, None, "assistant", "Hm.", *CLASHES)]


@pytest.mark.parametrize("seed", range(4))
def test_sweep_and_trace(seed):
    rng = random.Random(seed)
    for _ in range(150):
        codes = [rng.choice("suaxSUAXd") for _ in range(rng.randint(1, 9))]
        vectors, added = sweep("".join(codes), END)
        edits, state = trace("".join(codes), END, 0, True)
        assert (vectors[0][0] + sum(added), "".join(edits)) == cheapest(codes)
        assert state in (0, 3)
        for at in range(len(codes)):  # cut anywhere, from the vector behind the cut
            one, there = trace("".join(codes[:at]), vectors[at], 0, False)
            assert "".join(one + trace("".join(codes[at:]), END, there, True)[0]) == "".join(edits)


def test_chunks_converge_from_any_guess():
    """After a few rows, vectors from different guesses differ by a constant only."""
    rng = random.Random(1)
    line = [rng.choice("uasUA") for _ in range(400)]
    a, b = (0, 0, 0, 0), END
    for code in line:
        a, b = back(code, a)[0], back(code, b)[0]
    assert a == b


def compare(found, want):
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}


@pytest.mark.parametrize("bits", [0, 1, 8])
def test_query_on_awkward_rows(spark, monkeypatch, bits):
    """Chunks of one row, two rows, and whole conversations."""
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    data = table(bits)
    compare(repair_digests(spark.createDataFrame(data, SCHEMA)), expected(data))


def test_operator_rows_and_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", 3)
    rng = random.Random(9)
    long = [(500, i // 2, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["Same.", f"Own {i}.", f"Cut {i}", ""]), *CLASHES) for i in range(300)]
    blanks = [(600, i, "user", "", *CLASHES) for i in range(30)]
    data = long + blanks + table(3, 10)
    rng.shuffle(data)
    found = repair_conversations(spark.createDataFrame(data, SCHEMA))
    want = expected(data, hurt=False)
    got = {r.conv_id: tuple(r)[1:] for r in found.report.collect()}
    assert got == {k: v[:-2] for k, v in want.items()}
    lines = defaultdict(list)
    for r in sorted(found.rows.collect(), key=lambda r: (r.chunk, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert dict(lines) == {k: v[-1] for k, v in want.items() if v[-1]}
    assert want[600][5:7] == (90, "D" * 30)


def test_empty_and_lost(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_digests(empty).count() == 0 and repair_conversations(empty).rows.count() == 0
    lost = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair_digests(spark.createDataFrame([(lost, 0, "user", "Gone.", *CLASHES)], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert damage(spark.createDataFrame([(lost, 0, "user", "Gone.", *CLASHES)], SCHEMA)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op13_conversation_repair"](spark, sf_dir), expected(data))
