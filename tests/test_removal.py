"""Byte-exact removal and the active gate against plain Python."""

import hashlib
import json
import random

from decisa.operators import removal
from decisa.operators import requests as R
from pyspark.sql import functions as F


def spelt(rng, value, depth=0):
    """A JSON text with odd spaces and escapes."""
    gap = lambda: rng.choice(["", " ", "\n\t", "  "])
    if isinstance(value, dict):
        return "{" + ",".join(gap() + json.dumps(k) + gap() + ":" + gap() + spelt(rng, v, depth + 1) + gap() for k, v in value.items()) + gap() + "}"
    if isinstance(value, list):
        return "[" + ",".join(gap() + spelt(rng, v, depth + 1) + gap() for v in value) + "]"
    return json.dumps(value, ensure_ascii=rng.random() < 0.5)


def without(body, key, pointers):
    out = []
    for i, m in enumerate(body[key]):
        if f"/{key}/{i}/content" in pointers:
            continue
        if isinstance(m["content"], list):
            parts = [p for j, p in enumerate(m["content"]) if f"/{key}/{i}/content/{j}/text" not in pointers]
            if m["content"] and not parts:
                continue
            m = {**m, "content": parts}
        out.append(m)
    return {**body, key: out}


def bodies(n):
    rng = random.Random(9)
    rows, dropped = [], {}
    for k in range(n):
        key, wire = rng.choice([("messages", "openai_chat"), ("input", "openai_responses"), ("messages", "anthropic_messages")])
        text = lambda: rng.choice(["same", "same", 'q"\\uote\\', "é😀\n", "", "]},{["])
        part = lambda: {"type": "text", "text": text()}
        body = {"model": "m", key: [{"role": rng.choice(["user", "assistant"]), "content": text() if rng.random() < 0.5 else [part() for _ in range(rng.randrange(1, 4))]} for _ in range(rng.randrange(1, 7))], "stop": [",", "]"]}
        pointers = [f"/{key}/{i}/content" if isinstance(m["content"], str) else f"/{key}/{i}/content/{j}/text" for i, m in enumerate(body[key]) for j in range(1 if isinstance(m["content"], str) else len(m["content"]))]
        dropped[k] = (body, key, rng.sample(pointers, rng.randrange(len(pointers) + 1)))
        rows.append((k, wire, spelt(rng, body), dropped[k][2]))
    return rows, dropped


def test_bytes_come_back(spark):
    rows, dropped = bodies(150)
    df = spark.createDataFrame(rows, "k int, wire string, raw string, drops array<string>")
    parsed = R.parsed_requests(df, "k", "raw", "wire")
    cut = parsed.join(df, "k").withColumn("cuts", removal.request_cuts(F.col("spans"), F.col("drops")))
    cut = cut.withColumn("r", removal.removed_bytes(F.col("raw"), F.col("cuts"))).select("k", "reason", "raw", "cuts", "r.*")
    back = removal.restored_bytes(F.col("reduced"), F.col("held"), F.col("manifest"))
    for r in cut.withColumn("back", back).collect():
        body, key, pointers = dropped[r["k"]]
        want = without(body, key, pointers)
        assert r["reason"] is None
        if not want[key]:
            assert r["cuts"] is None and r["reduced"] is None and r["back"]["fault"] == "damaged_reduced"
            continue
        assert json.loads(r["reduced"]) == want and bytes(r["back"]["body"]) == r["raw"].encode() and r["back"]["fault"] is None
        assert r["manifest"]["sha256"] == hashlib.sha256(r["raw"].encode()).hexdigest() and len(r["held"]) == len(r["cuts"])
        assert b"".join(map(bytes, r["held"])) == b"".join(r["raw"].encode()[c["start"] : c["stop"]] for c in r["cuts"])


def test_damage_is_noticed(spark):
    raw = '{"messages": [ {"role":"user","content":"a"} , {"role":"assistant","content":"b"},{"role":"user","content":"a"}]}'
    df = spark.createDataFrame([(1, "openai_chat", raw)], "k int, wire string, raw string")
    cut = R.parsed_requests(df, "k", "raw", "wire").join(df, "k").withColumn("r", removal.removed_bytes(F.col("raw"), removal.request_cuts(F.col("spans"), F.array(F.lit("/messages/0/content"), F.lit("/messages/1/content"))))).select("r.*")
    moved = F.transform("manifest.cuts", lambda c: F.struct((c["start"] - 1).alias("start"), (c["stop"] - 1).alias("stop"), c["sha256"].alias("sha256")))
    whole = F.col("manifest").withField("cuts", moved)
    cases = {
        None: ("reduced", "held", "manifest"), "damaged_reduced": (F.concat("reduced", F.lit(b" ")), "held", "manifest"), "wrong_segment_count": ("reduced", F.slice("held", 1, 1), "manifest"),
        "damaged_segment": ("reduced", F.reverse("held"), "manifest"), "damaged_manifest": ("reduced", "held", whole), "no_held": ("reduced", F.lit(None).cast("array<binary>"), "manifest"),
    }
    for fault, parts in cases.items():
        got = cut.select(removal.restored_bytes(*[F.col(p) if isinstance(p, str) else p for p in parts]).alias("b")).select("b.*").first()
        assert got["fault"] == ("wrong_segment_count" if fault == "no_held" else fault) and (got["body"] is None) == (fault is not None)
