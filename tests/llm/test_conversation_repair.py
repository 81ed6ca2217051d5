"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import pairwise

from millrace.llm import conversation_repair as cr

COLS = "conv_id long, turn long, role string, text string, audit string, kind int"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def best(rows):
    """Cheapest edits by cost, then audit: every edit of the first row, every number of inserts before it."""
    ok = re.compile(r"(s?(ua)+)?")

    @cache
    def go(i, initials):
        options = []
        if i == len(rows) and ok.fullmatch(initials):
            options.append((0, "", ()))
        if not any(ok.fullmatch(initials + rest) for rest in ("", "u", "a", "ua", "sua")) or len(initials) > 2 * len(rows) + 3:
            return (10**9, "", ())
        if i < len(rows):
            fault, role, text = rows[i]
            c, a, r = go(i + 1, initials)
            options.append((c + 2, "D" + a, r))
            if fault in ("", "truncated"):
                stay = 5 * (fault == "truncated")
                for edit, own, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if own[:1] in ("s", "u", "a"):
                        c, a, r = go(i + 1, initials + own[0])
                        options.append((c + cost + stay, edit + a, (f"{own}:{text}", *r)))
        if initials.count("u") + initials.count("a") < i + 2 + len(rows):
            for own in ("user", "assistant"):
                if ok.fullmatch(initials + own[0]) or ok.fullmatch(initials + own[0] + "a"):
                    c, a, r = go(i, initials + own[0])
                    options.append((c + 5, "I" + a, (f"{own}:", *r)))
        return min(options)

    return go(0, "")


def brute_force(rows, ids):
    out = []
    for c in set(ids):
        own = sorted([r[1:] for r in rows if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((fault, role, text))
            counts[fault] = counts.get(fault, 0) + 1
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(own))
        cost, audit, turns = best(judged)
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(9)
    texts = ["Hello.", "so", "Yes!", "", " \n", None, "é?", "and then.  \n", "tab. "]
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(0, 6)):
            rows.append((c, rng.choice([t, t, t, t + 5, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]), rng.choice(texts)))
    return rows + [rows[3], rows[3], rows[8]]


def test_digest_against_all_edits(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], COLS)
    got = sorted(map(tuple, cr.repair_digest(cr.damaged(frame), frame).collect()), key=repr)
    assert got == brute_force(damaged(rows), [r[0] for r in rows])
    assert sum(r[6] for r in got) > 100


def test_conversation_with_everything_dropped_and_empty_table(spark):
    gone = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.", None, None)], COLS)
    (row,) = cr.repair_digest(cr.damaged(frame), frame).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_digest(cr.damaged(frame.limit(0)), frame.limit(0)).count() == 0


def test_one_conversation_over_many_parts(spark):
    """Most rows belong to one conversation; its pieces meet again, and turns and repeats across parts count once."""
    rng = random.Random(2)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "tool"]), rng.choice([f"Line {t}.", f"cut {t}", "Again.", ""])) for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(20, 60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cr.repair_digest(frame).collect()}
    own = sorted([r[1:] for r in rows if r[0] == 7], key=lambda r: (r[0], digest(*r[1:])))
    seen, letters = set(), []
    for _, role, text in own:
        letters.append("X" if not text or (role, text) in seen else (role[0] if role[0] in "sua" else "o") if text.endswith(".") else (role[0] if role[0] in "sua" else "o").upper())
        seen.add((role, text))
    nodes = [cr.END]
    for x in reversed(letters):
        nodes.append(cr.node(x, nodes[-1]))
    audit = cr.audit_of("".join(letters), nodes)
    assert (got[7].gaps, got[7].cost, got[7].audit) == (0, nodes[-1][0][0], audit)
    assert got[7].blank + got[7].duplicate == letters.count("X") and got[7].truncated == sum(x in "SUAO" for x in letters)
    assert got[7].illegal == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in pairwise(own))
    turns = cr.repaired(frame).where("conv_id = 7").orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == got[7].repaired_sha256
    assert re.fullmatch("(ua)*", "".join(t.role[0] for t in turns))
