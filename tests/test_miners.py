"""The outcome miner against a plain walk over a session."""

import json
import random
import re

from decisa.operators import miners


def call(name, **input_):
    return json.dumps({"tool_use": {"name": name, "input": input_}})


def plain(session, budget):
    """Every candidate's strongest, then earliest use, by comparing all segments."""
    units = []
    names = {}
    for place, (_, text) in enumerate(session):
        for w in {w.lower() for w in re.findall(miners.IDENTIFIER, text) if re.search(miners.SHAPED, w) or len(w) >= 12}:
            names[w] = names.get(w, 0) + 1
    calls = [p for p, (k, _) in enumerate(session) if k == "tool_use"]
    results = [p for p, (k, _) in enumerate(session) if k == "tool_result"]
    read, edits = {}, []
    for n, p in enumerate(calls):
        c = json.loads(session[p][1])["tool_use"]
        if c["name"] == "Edit":
            edits.append((p, c["input"]["path"]))
        elif n < len(results) and results[n] > p:
            read[results[n]] = ("path" if c["name"] == "Read" else "directory", c["input"]["path"])
    for place, (kind, text) in enumerate(session):
        own = [("url", u.rstrip(".,;")) for u in re.findall(miners.URL, text)]
        own += [("hash" if len(h) >= 10 else "short_hash", h) for h in re.findall(miners.HASH, text)]
        own += [("identifier", w.lower()) for w in re.findall(miners.IDENTIFIER, text) if (re.search(miners.SHAPED, w) or len(w) >= 12) and names[w.lower()] <= miners.RARE]
        if kind in ("user_turn", "assistant_text"):
            w = text.lower().split()
            own += [("phrase", " ".join(w[i : i + 6])) for i in range(len(w) - 5) if any(len(x) >= 5 for x in w[i : i + 6])]
        units.append(set(own))
    out = {}
    for place, (kind, _) in enumerate(session):
        if kind not in ("tool_result", "user_turn"):
            continue
        links = [(["strong", "medium", "weak"].index(miners.STRENGTH[k]), j, k, u) for k, u in units[place] for j in range(place + 1, len(session)) if session[j][0] in miners.USED_BY and (k, u) in units[j]]
        if place in read:
            k, path = read[place]
            links += [(0 if k == "path" else 2, j, k, path) for j, e in edits if j > place and (e if k == "path" else e.rsplit("/", 1)[0]) == path]
        if not links:
            continue
        rank, usage, k, u = min(links)
        users = [p for p, (kk, _) in enumerate(session[: usage + 1]) if kk == "user_turn"]
        if not users or users[-1] == place:
            continue
        size = [len(t.encode()) for _, t in session]
        anchor = users[-1]
        rest = max(0, budget - size[usage] - size[place] - (0 if anchor in (usage, place) else size[anchor]))
        first = usage
        while first > 0 and sum(size[first - 1 : usage]) <= rest:
            first -= 1
        shown = sorted({place, anchor, *range(first, usage + 1)})
        islands, text = [[shown[0], shown[0]]], ""
        for p in sorted({x for x in (place, anchor) if x < first}) or []:
            if islands[-1] != [p, p]:
                islands.append([p, p])
        islands = [[p, p] for p in sorted({x for x in (place, anchor) if x < first})] + [[first, usage]]
        at, parts = 0, []
        for a, b in islands:
            parts.append((f"[{a - at} omitted] " if a > at else "") + f"{a}-{b}")
            at = b + 1
        text = " ".join(parts)
        out[place] = ("keep" if rank < 2 else "uncertain", k, u, usage, anchor, first, sum(size[p] for p in shown), text)
    return out


def test_mined_outcomes(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "of", "the", "gamma9x", "my_long_name", "deadbeef12", "a1b2c3d4e5f6", "https://x.org/abc/def.", "camelCaseName", "shortword", "averyverylongword", "to", "and"]
    sessions = {}
    for k in range(25):
        s = []
        for i in range(rng.randrange(2, 25)):
            kind = rng.choice(["user_turn", "assistant_text", "tool_use", "tool_result"])
            text = " ".join(rng.choices(words, k=rng.randrange(1, 9)) + [f"u{i}"] * rng.randrange(3))
            if kind == "tool_use":
                name = rng.choice(["Read", "Edit", "ls"])
                text = call(name, path=rng.choice(["src/a/b.py", "src/a/c.py", "lib/d.py"]) if name != "ls" else rng.choice(["src/a", "lib"]))
            s.append((kind, text))
        sessions[f"s{k}"] = s
    rows = [(k, i, kind, text) for k, s in sessions.items() for i, (kind, text) in enumerate(s)]
    df = spark.createDataFrame(rows, "session string, place int, kind string, text string")
    from decisa.session import materialize

    df = materialize(df, "sessions")
    for budget in (150, 0):
        got = {}
        for r in miners.mined_outcomes(df, "session", budget).collect():
            got.setdefault(r["session"], {})[r["place"]] = (r["label"], r["unit_kind"], r["unit"], r["usage"], r["anchor"], r["first"], r["bytes"], r["window"])
        want = {k: w for k, s in sessions.items() if (w := plain(s, budget))}
        assert got == want
    assert miners.mined_outcomes(df.limit(0), "session").collect() == []
