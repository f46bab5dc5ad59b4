"""Reversible removal of segments, of texts in arrays and of bytes in bodies, and packing of segments into budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.ranks import numbered


def prove(df: DataFrame, by: str, pos: str, text: str, drop: Column, damage: Column | None = None) -> DataFrame:
    """(by, restored, dropped, turns): segments are dropped, and a manifest keeps only where they stood and a hash.

    Restoring puts the dropped segments back at the recorded indices and compares each hash and the whole's hash.
    `damage` marks dropped segments that were kept badly: they come back with a character more, and must be noticed."""
    rows = df.select(by, F.struct(pos, F.coalesce(F.col(text), F.lit("")).alias("t"), drop.alias("d"), F.coalesce(damage if damage is not None else F.lit(False), F.lit(False)).alias("x")).alias("s"))
    g = rows.groupBy(by).agg(F.sort_array(F.collect_list("s")).alias("all"))
    kept = F.transform(F.filter("all", lambda s: ~s["d"]), lambda s: s["t"])
    gone = F.transform(F.filter("all", lambda s: s["d"]), lambda s: s["t"])
    spots = F.filter(F.transform("all", lambda s, i: F.when(s["d"], i)), lambda i: i.isNotNull())
    hashes = F.transform(gone, lambda t: F.sha2(t, 256))
    gone = F.transform(F.filter("all", lambda s: s["d"]), lambda s: F.concat(s["t"], F.when(s["x"], "?").otherwise("")))
    g = g.select(by, F.sha2(F.array_join(F.transform("all", lambda s: s["t"]), "\x1f"), 256).alias("was"), kept.alias("kept"), gone.alias("gone"), spots.alias("spots"), hashes.alias("hashes"))
    put = F.aggregate(F.arrays_zip("spots", "gone"), F.col("kept"), lambda a, x: F.concat(F.slice(a, F.lit(1), x["spots"]), F.array(x["gone"]), F.slice(a, x["spots"] + 1, F.size(a))))
    g = g.withColumn("back", put)
    same = F.sha2(F.array_join("back", "\x1f"), 256) == F.col("was")
    each = F.forall(F.arrays_zip("gone", "hashes"), lambda x: F.sha2(x["gone"], 256) == x["hashes"])
    return g.select(by, (same & each).alias("restored"), F.size("gone").cast("long").alias("dropped"), F.size("back").cast("long").alias("turns"))


CUTS = "array<struct<start: bigint, stop: bigint>>"


def _let(value: Column, body) -> Column:
    """body(value), in which value is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def list_cuts(items: Column, gone: Column) -> Column:
    """The bytes to cut so that a JSON array loses items: items holds every item's (start, stop) in order, gone the indices
    to drop. An item goes with the comma after it; those behind the last kept one go with the comma before them. Null when
    none is kept."""
    kept = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda k: ~F.array_contains(gone, k))
    cut = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"))

    def cuts(last: Column) -> Column:
        inner = F.transform(F.filter(F.array_sort(F.array_distinct(gone)), lambda k: k < last), lambda k: cut(F.get(items, k)["start"], F.get(items, k + 1)["start"]))
        tail = F.when(last < F.size(items) - 1, F.array(cut(F.get(items, last)["stop"], F.element_at(items, -1)["stop"]))).otherwise(F.array().cast(CUTS))
        return F.when(last.isNotNull(), F.concat(inner, tail))

    return _let(F.array_max(kept), cuts)


def request_cuts(spans: Column, pointers: Column) -> Column:
    """The bytes to cut so that a request loses the segments at pointers; spans is parsed_requests()'s column. A message
    whose content, or all of whose parts, are named goes whole. Null when no message would be left."""
    named = lambda i, rest: F.exists(pointers, lambda p: p.rlike(r"^/[a-z]+/[0-9]+/content(/[0-9]+/text)?$") & (F.split(p, "/")[2].cast("int") == i) & rest(p))
    part = lambda m, j: named(m["i"], lambda p: F.get(F.split(p, "/"), F.lit(4)).cast("int") == j)
    parts = lambda m: F.coalesce(m["parts"], F.array().cast(CUTS))
    lost = lambda m: F.filter(F.transform(parts(m), lambda s, j: F.when(part(m, j), j)), lambda j: j.isNotNull())
    seen = F.transform(spans, lambda m: F.struct(m["i"].alias("i"), m["span"].alias("span"), parts(m).alias("parts"), lost(m).alias("lost"), named(m["i"], lambda p: F.size(F.split(p, "/")) == 4).alias("named")))

    def cuts(seen: Column, whole: Column) -> Column:
        within = F.filter(seen, lambda m: (F.size(m["lost"]) > 0) & ~F.array_contains(whole, m["i"]))
        inner = F.flatten(F.transform(within, lambda m: list_cuts(m["parts"], m["lost"])))
        outer = F.when(F.size(whole) > 0, list_cuts(F.transform(seen, lambda m: m["span"]), whole)).otherwise(F.array().cast(CUTS))
        return F.array_sort(F.concat(outer, inner))

    whole = lambda seen: F.filter(F.transform(seen, lambda m: F.when(m["named"] | ((F.size(m["lost"]) > 0) & (F.size(m["lost"]) == F.size(m["parts"]))), m["i"])), lambda i: i.isNotNull())
    return _let(seen, lambda s: _let(whole(s), lambda w: cuts(s, w)))


def removed_bytes(raw: Column, cuts: Column) -> Column:
    """(reduced, held, manifest) of a text or bytes: what is left without the cuts, the cut bytes for the caller to keep,
    and a manifest without content: sizes and SHA-256 of both bodies, and start, stop and SHA-256 of each cut.

    Cuts are disjoint and in order; there are at most a few hundred, as each one copies what was put together before."""
    bytes_of = lambda body, start, stop: F.substring(body, (start + 1).cast("int"), (stop - start).cast("int"))
    zero = F.struct(F.lit(b"").alias("body"), F.lit(0).cast("long").alias("at"))
    size = lambda body: F.octet_length(body).cast("long")

    def reduced(body: Column, cuts: Column) -> Column:
        walk = F.aggregate(cuts, zero, lambda a, c: F.struct(F.concat(a["body"], bytes_of(body, a["at"], c["start"])).alias("body"), c["stop"].alias("at")), lambda a: F.concat(a["body"], bytes_of(body, a["at"], size(body))))
        held = F.transform(cuts, lambda c: bytes_of(body, c["start"], c["stop"]))
        records = F.transform(cuts, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.sha2(bytes_of(body, c["start"], c["stop"]), 256).alias("sha256")))
        manifest = lambda r: F.struct(size(body).alias("bytes"), F.sha2(body, 256).alias("sha256"), size(r).alias("reduced_bytes"), F.sha2(r, 256).alias("reduced_sha256"), records.alias("cuts"))
        return _let(walk, lambda r: F.struct(r.alias("reduced"), held.alias("held"), manifest(r).alias("manifest")))

    return _let(F.struct(raw.cast("binary").alias("body"), cuts.alias("cuts")), lambda x: reduced(x["body"], x["cuts"]))


def restored_bytes(reduced: Column, held: Column, manifest: Column) -> Column:
    """(body, fault): the original bytes out of what is left, what the caller kept, and the manifest; body is null with a
    fault: damaged_reduced, wrong_segment_count, damaged_segment, damaged_manifest, whichever is first. A null is a fault
    of its part."""
    zero = F.struct(F.lit(b"").alias("body"), F.lit(0).cast("long").alias("at"))
    true = lambda c: F.coalesce(c, F.lit(False))

    def checked(body: Column, held: Column, m: Column) -> Column:
        both = F.arrays_zip(m["cuts"].alias("cuts"), held.alias("held"))

        def put(a: Column, x: Column) -> Column:
            more = x["cuts"]["start"] - F.octet_length(a["body"])
            return F.struct(F.concat(a["body"], F.substring(body, (a["at"] + 1).cast("int"), F.greatest(more, F.lit(0)).cast("int")), x["held"]).alias("body"), (a["at"] + more).alias("at"))

        whole = F.aggregate(both, zero, put, lambda a: F.concat(a["body"], F.substring(body, (a["at"] + 1).cast("int"), F.octet_length(body))))
        fine = F.forall(both, lambda x: true((F.octet_length(x["held"]) == x["cuts"]["stop"] - x["cuts"]["start"]) & (F.sha2(x["held"], 256) == x["cuts"]["sha256"])))
        fault = lambda w: (
            F.when(~true((F.octet_length(body) == m["reduced_bytes"]) & (F.sha2(body, 256) == m["reduced_sha256"])), "damaged_reduced")
            .when(~true(F.size(held) == F.size(m["cuts"])), "wrong_segment_count").when(~true(fine), "damaged_segment")
            .when(~true((F.octet_length(w) == m["bytes"]) & (F.sha2(w, 256) == m["sha256"])), "damaged_manifest")
        )
        return _let(whole, lambda w: _let(fault(w), lambda f: F.struct(F.when(f.isNull(), w).alias("body"), f.alias("fault"))))

    return _let(F.struct(reduced.cast("binary").alias("body"), held.alias("held"), manifest.alias("manifest")), lambda x: checked(x["body"], x["held"], x["manifest"]))


def pack(df: DataFrame, by: str, pos: str, cost: str, budget: int) -> DataFrame:
    """(by, row, first, last, used): segments in order, a new row where the next one would pass the budget. One pass over
    a conversation's positions and costs."""
    rows = df.select(by, F.col(pos).cast("long").alias("p"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("c"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "c"])
        out: list[list[int]] = []
        for p, c in zip(pdf["p"].tolist(), pdf["c"].tolist(), strict=True):
            if out and out[-1][3] + c <= budget:
                out[-1][2:] = [p, out[-1][3] + c]
            else:
                out.append([len(out), p, p, c])
        return pd.DataFrame(out, columns=["row", "first", "last", "used"]).assign(**{by: pdf[by].iloc[0]})[[by, "row", "first", "last", "used"]]

    return rows.groupBy(by).applyInPandas(fill, f"`{by}` {df.schema[by].dataType.simpleString()}, row int, first long, last long, used long")


#: Token arrays that are packed together at most.
PACKED_TOGETHER = 4096


def pack_prefixes(df: DataFrame, by: str, id_: str, tokens: str, budget: int, together: int = PACKED_TOGETHER) -> DataFrame:
    """(by, id, block, row, shared, cost): token arrays packed into rows of at most `budget` tokens, in which a prefix that
    neighbours share counts once.

    Arrays stand in their order, which puts those with long common prefixes side by side, then by id. One costs its tokens
    without the `shared` first ones that it has in common with the one before it in its row; a new row begins, where
    nothing is shared, when the cost would pass the budget. An array longer than the budget has a row of its own. Each
    group's order is cut into blocks of `together` arrays, in which rows are filled in one pass, so a group of any size is
    spread over tasks and a block costs at most one row that isn't full. A null array is empty."""
    rows = df.select(by, F.col(id_).alias("id"), F.coalesce(F.col(tokens), F.array().cast(df.schema[tokens].dataType)).alias("tokens"))
    placed = numbered(rows, [by], [F.col("tokens"), F.col("id")], "_place").withColumn("block", F.floor((F.col("_place") - 1) / together))
    by_type, id_type = df.schema[by].dataType.simpleString(), df.schema[id_].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        row, used, before, out = -1, budget + 1, (), []
        for x in pdf["tokens"].tolist():
            same = 0
            for a, b in zip(before, x, strict=False):
                if a != b:
                    break
                same += 1
            if row < 0 or used + len(x) - same > budget:
                row, used, same = row + 1, 0, 0
            used += len(x) - same
            out.append((row, same, len(x) - same))
            before = x
        filled = pd.DataFrame(out, columns=["row", "shared", "cost"])
        return pd.concat([pdf[[by, "id", "block"]].reset_index(drop=True), filled], axis=1)

    return placed.groupBy(by, "block").applyInPandas(fill, f"`{by}` {by_type}, id {id_type}, block long, row long, shared long, cost long")
