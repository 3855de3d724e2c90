"""Conversation repair against all edit sequences by dynamic programming over whole conversations, and the search against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from attestra.llm import conversations as conv

FITS = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def plain(rows):
    """Least (cost, audit, roles so far) by all prefixes: states are the roles' last initial; every audit is carried whole."""
    found = faults(rows)
    best = {"": (0, "", ())}

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for last, (cost, audit, turns) in list(best.items()):
                new = "a" if last == "u" else "u"
                option = (cost + 3, audit + "I", (*turns, ({"u": "user", "a": "assistant"}[new], "")))
                best[new] = min(best.get(new, option), option, key=lambda o: o[:2])
        return best

    for (role, text), fault in zip(rows, found, strict=True):
        new = {}

        def offer(last, option):
            new[last] = min(new.get(last, option), option, key=lambda o: o[:2])

        for last, (cost, audit, turns) in inserts(best).items():
            offer(last, (cost + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            i = role[:1]
            if (i == "s" and last == "") or (i == "u" and last != "u") or (i == "a" and last == "u"):
                offer(i, (cost + extra, audit + "K", (*turns, (role, text))))
            r = "assistant" if last == "u" else "user"
            offer(r[0], (cost + 3 + extra, audit + "R", (*turns, (r, text))))
        best = new
    cost, audit, turns = min((o for last, o in inserts(best).items() if last in ("", "a")), key=lambda o: o[:2])
    assert FITS.fullmatch("".join(r[:1] for r, _ in turns))
    return cost, audit, turns


def everything(codes):
    """Least (cost, audit) over every edit sequence with few insertions."""
    best = None
    for n in range(len(codes) + 4):
        for edits in itertools.product("DIKR", repeat=len(codes) + n):
            if sum(e != "I" for e in edits) != len(codes):
                continue
            # roles of renamed and inserted turns are forced by the pattern
            cost, at, state = 0, 0, ""
            for e in edits:
                if e == "I":
                    cost, state = cost + 3, "a" if state == "u" else "u"
                    continue
                c = codes[at]
                at += 1
                if e == "D":
                    cost += 4
                    continue
                if conv.FAULT[c] in ("blank", "duplicate"):
                    break
                cost += 3 * (conv.FAULT[c] == "truncated") + 3 * (e == "R")
                new = ("a" if state == "u" else "u") if e == "R" else conv.INITIAL[c]
                if not ((new == "s" and state == "") or (new == "u" and state != "u") or (new == "a" and state == "u")):
                    break
                state = new
            else:
                if state in ("", "a"):
                    best = min(best or (cost, "".join(edits)), (cost, "".join(edits)))
    return best


def test_search_against_all_edits():
    r = random.Random(4)
    letters = list(conv.INITIAL)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n == 3 else 16):
            codes = "".join(r.choices(letters, k=n))
            (found,) = conv.search(codes, goals=conv.GOALS).values()
            assert found == everything(codes)


@pytest.mark.parametrize("size", [1, 2, 5, 256])
def test_fold_of_blocks(size):
    r = random.Random(size)
    for _ in range(60):
        codes = "".join(r.choices(list(conv.INITIAL), weights=[6, 9, 9, 1] + [1] * 12, k=r.randint(1, 40)))
        fold = conv.Fold()
        for i in range(0, len(codes), size):
            fold.add(codes[i : i + size], conv.paths(codes[i : i + size], i > 0), None, None, 0)
        (whole,) = conv.search(codes, goals=conv.GOALS).values()
        assert fold.row()[-2:] == whole


def made():
    r = random.Random(9)
    rows = []
    for c in [*range(60), None]:
        for t in range(r.choice([0, 1, 2, 5, 8])):
            role = r.choice(["system"] if t == 0 and r.random() < 0.4 else ["user", "assistant", "tool", "", None])
            rows.append((c, t + r.choice([0, 0, 0, 3]) * 10 + t, role if r.random() < 0.3 else ["user", "assistant"][t % 2], r.choice(["Hi there.", "cut off here", "What?", "  ", "", None, "end.\n", "Done! \x0b", "x" * 3000 + "é"])))
    rows += [(777, t, ["user", "assistant"][t % 2] if t % 7 else "user", f"text {t % 900}" + "." * (t % 5 > 0)) for t in range(3000)]  # many blocks
    rows += [(778, 5, "user", "same.")] * 700  # equal rows are many blocks
    rows += [(779, None, "system", "Be kind."), (779, 1, "user", "Yes?"), (779, 2, "assistant", "No.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, seq int, `a.b` string"


def expected(rows, original):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t, r, x))
    out = {}
    for c in {r[0] for r in original}:
        found = sorted(groups[c], key=lambda o: (o[0] is not None, o[0] or 0, o[1], hashlib.md5(o[2].encode()).hexdigest()))
        pairs = [(r, x) for _, r, x in found]
        turns = [t for t, _, _ in found if t is not None]
        f = faults(pairs)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, fixed = plain(pairs)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        out[c] = ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha), list(fixed)
    return out


def test_repairs_equal_plain_version(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    want = expected(damage(rows), rows)
    got = {r[0]: tuple(r)[1:] for r in conv.digest(df, conv.damaged(df)).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    summary, fixed = conv.repair(conv.damaged(df))
    turns = defaultdict(list)
    for r in sorted(fixed.collect(), key=lambda r: r.place):
        turns[r.conv_id].append((r.role, r.text))
    assert all(turns[c] == t for c, (_, t) in want.items()) and {r[0]: tuple(r)[1:] for r in summary.collect()} == {c: w[:-1] for c, (w, _) in want.items() if any(d[0] == c for d in damage(rows))}


def test_undamaged_null_columns_and_empty(spark):
    rows = [(1, None, "user", None), (1, None, "assistant", "Ok."), (2, 1, None, "Hm."), (3, 1, "assistant", "a."), (3, 1, "user", "b."), (4, 1, "user", "a."), (4, 2, "user", "a.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = {r[0]: tuple(r)[1:] for r in conv.digest(df, df).collect()}
    assert got == {c: w for c, (w, _) in expected(clean, rows).items()}
    assert conv.digest(df.where("false"), df.where("false")).count() == 0
    gone = conv.digest(df, df.where("false")).collect()
    assert len(gone) == 4 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)
