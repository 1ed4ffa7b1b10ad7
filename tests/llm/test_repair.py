import hashlib
import itertools
import random
import re
import zlib

from sitelore.llm import repair
from sitelore.llm.survivors import END_COSTS, Survivors, transfer

SCHEMA = "conv_id long, turn long, role string, text string, edit int, cost string, _pos int"
BLANK = " \t\n\x0b\f\r"


def endings(turns):
    """(cost, audit) of the best ending of each state, whole strings compared."""
    most = 10**9

    def with_inserts(g):
        for _ in range(3):
            for s, t in enumerate((2, 2, 3, 2)):
                g[s] = min(g[s], (g[t][0] + 3, "I" + g[t][1]))
        return g

    f = with_inserts([(0, ""), (most, ""), (most, ""), (0, "")])
    for role, fault in reversed(turns):
        g = []
        for s in range(4):
            options = [(f[s][0] + 4, "D" + f[s][1])]
            for who in "sua" if fault not in "bd" else "":
                t = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}[who].get(s)
                if t is not None and (who == role or who != "s"):
                    cost, letter = (0, "K") if who == role else (3, "R")
                    options.append((f[t][0] + cost + 3 * (fault == "t"), letter + f[t][1]))
            g.append(min(options))
        f = with_inserts(g)
    return f


def test_survivors_are_the_best_endings():
    rng = random.Random(1)
    for _ in range(1500):
        turns = [(rng.choice("suaux "), rng.choice("....tbd")) for _ in range(rng.randrange(0, 14))]
        found = Survivors()
        for initial, fault in reversed(turns):
            found.before(initial, fault)
        want = endings(turns)
        assert [(found.costs[s], found.edits(s)) for s in range(4)] == want
        m = transfer(turns)
        assert [min(m[s][t] + END_COSTS[t] for t in range(4)) for s in range(4)] == found.costs


def test_best_of_all_edit_strings():
    """Every string of edits up to a length, applied as it reads."""
    for turns in itertools.product([("u", "."), ("a", "."), ("s", "t"), ("a", "t"), ("u", "d"), ("x", ".")], repeat=3):
        found = Survivors()
        for initial, fault in reversed(turns):
            found.before(initial, fault)
        best = (10**9, "")
        for n in range(3, 6):
            for edits in itertools.product("KRDI", repeat=n):
                if sum(e != "I" for e in edits) != 3:
                    continue
                said, rest, cost = "", iter(turns), 0
                for e in edits:
                    follows = "a" if said.endswith("u") else "u"
                    initial, fault = next(rest) if e != "I" else ("", ".")
                    if e in "KR" and fault in "bd":
                        break
                    cost += {"K": 0, "R": 3, "D": 4, "I": 3}[e] + 3 * (fault == "t" and e != "D")
                    said += {"K": initial, "D": ""}.get(e, follows)
                else:
                    if re.fullmatch("(s?(ua)+)?", said):
                        best = min(best, (cost, "".join(edits)))
        assert (found.costs[0], found.edits()) == best, turns


def test_memory_is_bounded_by_what_is_unresolved():
    rng = random.Random(2)
    found, most = Survivors(), 0
    for i in range(5000):
        found.before(rng.choice("suauaua"), rng.choice(".......tbd"))
        most = max(most, found.unresolved())
    assert most < 60 and len(found.out) > 4900


def by_hand(rows):
    """The report from plain lists."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in (r[:4] for r in rows):
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        c = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if c == 1:
            text = ""
        elif c == 2:
            text = re.sub("[.!?]", "", text)
        elif c == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    result = {}
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), ""
        for _, role, text in turns:
            shown = text.rstrip(BLANK)
            faults += "b" if not shown else "d" if (role, text) in seen else "." if shown[-1] in ".!?" else "t"
            seen.add((role, text))
        cost, audit = endings([(r[:1], f) for (_, r, _), f in zip(turns, faults)])[0]
        lines, rest, last = [], iter(turns), ""
        for e in audit:
            role, text = ("", "") if e == "I" else next(rest)[1:]
            if e in "IR":
                role = "assistant" if last == "u" else "user"
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        numbers = [t for t, *_ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        result[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("b"), faults.count("d"),
            faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return result


def conversations():
    rng = random.Random(3)
    words = ["Hello.", "Why?", "no end", "", " \n", "Hello. ", "Ünd!", None, "a.b", "x" * 50000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "unknown"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 12)):
            plain = rng.random() < 0.7
            role = ["user", "assistant"][turn % 2] if plain else rng.choice(roles)
            at = turn if rng.random() < 0.9 else rng.choice([None, turn, 3])
            rows.append((conv, at, role, rng.choice(words[:1] * 8 + words) if not plain else f"Say {turn}.", 1, "", 2))
    for turn in range(400):  # a third of all rows
        rows.append((99, turn, rng.choice(roles[1:5]), rng.choice(["Yes.", f"No {turn}.", f"what {turn}", ""]), 1, "", 2))
    return rows + [(77, 0, "user", "Twice.", 1, "", 2)] * 6


def test_report_equals_plain_lists_for_every_block(spark):
    rows = conversations()
    want = by_hand(rows)
    said = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block in (4096, 7, 1):
        got = repair.repair_report(repair.damaged(said), said, block=block).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert {c for w in want.values() for c in w[6]} == set("KRDI")


def test_repaired_turns_are_what_the_report_hashes(spark):
    said = spark.createDataFrame(conversations(), SCHEMA)
    hurt = repair.damaged(said)
    report = {r.conv_id: r for r in repair.repair_report(hurt, said, block=9).collect()}
    lines = {c: [] for c in report}
    for r in sorted(repair.repaired_turns(hurt, block=9).collect(), key=lambda r: r.place):
        assert len(lines[r.conv_id]) == r.place
        lines[r.conv_id].append(r)
    for conv, turns in lines.items():
        text = "\n".join(f"{t.role}:{t.text}" for t in turns)
        assert hashlib.sha256(text.encode()).hexdigest() == report[conv].repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in turns))
        assert "".join(t.edit for t in turns) == report[conv].audit.replace("D", "")


def test_nothing_left_and_nothing_there(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    said = spark.createDataFrame([(conv, 0, "user", "Hi.", 0, "", 0)], SCHEMA)
    assert [tuple(r) for r in repair.repair_report(repair.damaged(said), said).collect()] == [
        (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]
    none = said.limit(0)
    assert repair.repair_report(none, none).count() == 0 and repair.repaired_turns(none).count() == 0
