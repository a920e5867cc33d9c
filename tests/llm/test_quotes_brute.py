"""Quotation links and threads of random conversations against a plain linker."""

import re

import numpy as np

from earshot.llm import quotes

QUOTE = re.compile(r"^\s*(?:>\s*)+")
WROTE = re.compile(r"^.{0,200}\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)


def normal(text):
    return "".join(c for c in text.lower() if c.isalnum())


def lines_of(text):
    rows = [((QUOTE.match(x) or [""])[0].count(">"), QUOTE.sub("", x)) for x in re.split("\r\n|\r|\n", text)]
    return [r for i, r in enumerate(rows) if not (r[0] == 0 and WROTE.match(r[1]) and i + 1 < len(rows) and rows[i + 1][0] > 0)]


def pieces(text):
    return [text, *re.split(r"\n\s*\n", text), *text.split("\n")]


def own_text(rows):
    return re.sub(r"^\s+|\s+$", "", re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(b for n, b in rows if n == 0)))


def brute(messages):
    """(conv, turn, role, text) -> {(conv, turn): (to_conv, to_turn)}, threads and depths."""
    originals, quoted = {}, {}
    for c, t, _, text in messages:
        if c is None or t is None:
            continue
        rows = lines_of(text or "")
        for p in {normal(x) for x in pieces(own_text(rows))} - {""}:
            originals.setdefault(p, set()).add((c, t))
        run, place = [], 0
        for i, (n, body) in enumerate(rows):
            run.append(body)
            if i + 1 == len(rows) or rows[i + 1][0] != n:
                if n:
                    whole = "\n".join(run)
                    own = {normal(whole)} | {p for p in map(normal, pieces(whole)) if len(p) >= quotes.LEAST_CHARS}
                    quoted.setdefault((c, t), []).append((place, n, own - {""}))
                run, place = [], place + 1
    links = {}
    for (c, t), parts in quoted.items():
        found = []
        for place, n, own in parts:
            here = [(False, n, -len(p), -u, place, c) for p in own for d, u in originals.get(p, ()) if d == c and u < t]
            latest = {x[2]: min(y for y in here if y[2] == x[2]) for x in here}
            found += here
            if not here:
                for p in own:
                    there = sorted(o for o in originals.get(p, ()) if o[0] != c)
                    if there and len(p) >= quotes.LEAST_CHARS:
                        found.append((True, n, -len(p), -there[0][1], place, there[0][0]))
            del latest
        if found:
            m = min(found)
            links[c, t] = (m[5], -m[3])
    thread = {}
    for c, t in sorted({(c, t) for c, t, *_ in messages if c is not None and t is not None}):
        at, depth = (c, t), 0
        while at in links and links[at][0] == c:
            at, depth = links[at], depth + 1
        thread[c, t] = at[1], depth
    return links, thread


def test_random_threads(spark):
    rng, rows = np.random.default_rng(9), []
    said = [f"{a} {b} {c} now" for a in ("please read", "I installed", "nobody knows", "why not") for b in ("the manual", "this thing", "that answer") for c in ("twice", "again", "today")]
    said += ["yes", "no!", "Ok."]
    for c in range(40):
        texts = []
        for t in range(int(rng.integers(1, 9))):
            parts = []
            for _ in range(int(rng.integers(0, 4))):
                kind, pool = int(rng.integers(5)), texts or [said[0]]
                if kind < 2:
                    source = pool[int(rng.integers(len(pool)))] if rng.random() < 0.7 else said[int(rng.integers(len(said)))]
                    lines = source.split("\n")
                    cut = lines[int(rng.integers(len(lines))) :]
                    parts += ["Anna wrote:"] * (kind == 1) + [(">" + " " * int(rng.integers(2))) * int(rng.integers(1, 3)) + x.upper() for x in cut]
                else:
                    parts += [said[int(rng.integers(len(said)))], ""][: int(rng.integers(1, 3))]
            text = "\n".join(parts)
            texts.append(text)
            rows.append((c, t, "ua"[t % 2], text))
    rows += [rows[5], (7, 3, "x", None), (None, 1, "u", "> " + said[0]), (3, None, "u", "> " + said[0]), (50, 0, "u", said[0] + "\n" + "filler line of words\n" * 20_000), (50, 1, "a", "> filler line of words\n" * 3000 + "\n> " + said[0])]
    rows += [(60, t, "u", said[1] if t % 2 else "> " + said[1]) for t in range(1_500)]  # one conversation repeats a passage
    df = spark.createDataFrame([(*r, "h") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    got = quotes.conversations(df).collect()
    links, thread = brute(rows)
    assert len(got) == len(rows) and len(links) > 80
    assert {(r.conv_id, r.turn): (r.reply_to_conv, r.reply_to_turn) for r in got if r.reply_to_conv is not None} == links
    assert {(r.conv_id, r.turn): (r.thread, r.depth) for r in got if r.conv_id is not None and r.turn is not None} == thread
    for c in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        keys = [(r.thread is not None, r.thread or 0, r.turn or 0) for r in own]
        assert keys == sorted(keys)
