"""N-gram Jaccard join by signature trees.

How it is spread over a cluster, without losing a link:

1. Each text becomes the set of its word shingles (64-bit hashes) in one pass. Equal sets are one class, so exact
   copies cost one row each from here on.
2. Two sets of similarity t share a token among the (1-t) part of smallest hashes, and at least c tokens among that
   part lengthened by c. So only these prefixes travel: packed and sorted, a row for each batch and hash range, each
   token once a batch. A class with too few shared prefix tokens can link with nothing and is done.
3. The remaining classes meet in blocks: a prefix token's block is named by its smallest class, so the many tokens
   that the same classes share make one block, not one each. Here prefixes put the corpus's most frequent tokens
   last (any one order of tokens loses nothing), so a passage that many texts share brings few of them together.
   Large blocks are split into chunks of bounded size.
4. In a chunk, a signature tree joins itself by dual traversal; candidate pairs are verified on whole sets, and only
   the links that connect (a forest) leave the task. Between chunks of one block, sets already linked with the
   block's first class need no more comparing with each other; the others' trees are joined with every chunk.
5. Components of the links come from alternating star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisa.llm.signature_tree import forest_edges
from decisa.llm.words import U64, fingerprint, shingle_sets, tidy
from decisa.operators.components import connected_components
from decisa.session import materialize, own_batches

#: Marks a token that several texts of a batch hold; the other bits count them. Else they are its text's place.
MANY = 1 << 31
BATCH_TOKENS = 1 << 20
#: Sets in one chunk of a block.
CHUNK = 512
#: Class ids up to this count (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Classes of more than HOT_ROWS equal texts are broadcast to their rows, the largest HOT_CLASSES of them (60 bytes
#: each); any other class has at most a HOT_CLASSES-th of all rows.
HOT_ROWS, HOT_CLASSES = 100, 20_000
#: Tokens that prefixes put last: those with FREQUENT texts or more, the most frequent HOT_TOKENS of them (12 bytes
#: each go to every task). Which ones they are changes the work, never the links.
FREQUENT, HOT_TOKENS = 24, 200_000
SPREAD = 0xD1342543DE82EF95  # spreads the smallest hashes over all ranges
UNSPREAD = pow(SPREAD, -1, 1 << 64)

PASS_ONE = "fp binary, doc_id long, key string, n long, batch long, pos int, own int, need int, bucket int, tokens binary, places binary"


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _reach(n: int, num: int, den: int) -> tuple[int, int]:
    """The lengthened prefix of a set of n tokens, and how many of its tokens must be shared."""
    extra = n // 10
    return min(n, _prefix(n, num, den) + extra), max(1, (-(-num * n // den)) // 10)


def _pass_one(width: int, num: int, den: int, buckets: int):
    shift = U64(64 - (buckets.bit_length() - 1))
    schema = pa.schema([("fp", pa.binary()), ("doc_id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("batch", pa.int64()), ("pos", pa.int32()), ("own", pa.int32()), ("need", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("places", pa.binary())])

    def flush(batch: int, rows: list, seen: dict) -> list[dict]:
        out = []
        heads = [x[:y] for x, y in seen.values()]
        own = np.zeros(len(heads), np.int64)
        if heads:
            tokens = np.concatenate(heads) * U64(SPREAD)
            places = np.repeat(np.arange(len(heads), dtype=np.uint32), [len(x) for x in heads])
            order = np.argsort(tokens, kind="stable")
            tokens, places = tokens[order], places[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(tokens)))
            own += np.bincount(places[np.repeat(times > 1, times)], minlength=len(heads))
            tokens, places = tokens[at], np.where(times > 1, MANY + times, places[at]).astype(np.uint32)
            cut = np.searchsorted(tokens >> shift, np.arange(buckets + 1, dtype=U64))
            for k in range(buckets):
                if cut[k] < cut[k + 1]:
                    out.append({"batch": batch, "bucket": k, "tokens": tokens[cut[k] : cut[k + 1]].tobytes(), "places": places[cut[k] : cut[k + 1]].tobytes()})
        index = {fp: i for i, fp in enumerate(seen)}
        for fp, doc, key, n in rows:
            i = index.get(fp)
            out.append({"fp": fp, "doc_id": doc, "key": key, "n": n, "batch": batch, "pos": i, "own": int(own[i]) if i is not None else 0, "need": _reach(n, num, den)[1]})
        return out

    def run(batches):
        from pyspark import TaskContext

        batch, rows, seen, size = TaskContext.get().partitionId() << 24, [], {}, 0
        for b in batches:
            for a in range(0, len(b), 256):
                some = b.slice(a, 256)
                for doc, s, key in zip(some.column(0).to_pylist(), shingle_sets(some.column(1).to_pylist(), width), some.column(2).to_pylist(), strict=True):
                    fp = fingerprint(s) if len(s) else None
                    rows.append((fp, doc, key, len(s)))
                    if len(s) and fp not in seen:
                        reach = _reach(len(s), num, den)[0]
                        seen[fp] = (s[:reach].copy(), reach)
                        size += reach
                if size >= BATCH_TOKENS:
                    yield pa.RecordBatch.from_pylist(flush(batch, rows, seen), schema)
                    batch, rows, seen, size = batch + 1, [], {}, 0
        if rows:
            yield pa.RecordBatch.from_pylist(flush(batch, rows, seen), schema)

    return run


def _shared_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: for each batch, how many tokens of each place other texts hold too; frequent tokens with
    their numbers of texts in a row without a batch."""
    tokens = np.concatenate([np.frombuffer(x, U64) for x in rows["tokens"]])
    places = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["places"]])
    batch = np.repeat(rows["batch"].to_numpy(), [len(x) // 8 for x in rows["tokens"]])
    order = np.argsort(tokens, kind="stable")
    tokens, places, batch = tokens[order], places[order], batch[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    at = np.flatnonzero(first)
    texts = np.add.reduceat(np.where(places >= MANY, places.astype(np.int64) - MANY, 1), at)
    hot = texts >= FREQUENT
    out = [(None, (tokens[at][hot] * U64(UNSPREAD)).tobytes(), texts[hot].astype(np.uint32).tobytes())]
    shared = np.repeat(texts > 1, np.diff(np.append(at, len(tokens)))) & (places < MANY)
    places, batch = places[shared], batch[shared]
    for k in np.unique(batch):
        at, n = np.unique(places[batch == k], return_counts=True)
        out.append((int(k), at.astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["batch", "places", "counts"]).astype({"batch": "Int64"})


def _frequent_tokens(batches):
    schema = pa.schema([("token", pa.int64()), ("texts", pa.int64())])
    for b in batches:
        for tokens, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, np.int64)), pa.array(np.frombuffer(texts, np.uint32).astype(np.int64))], schema=schema)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    places = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["places"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]])
    total = np.bincount(places, counts).astype(np.int64)
    at = np.flatnonzero(total)
    return pd.DataFrame({"batch": rows["batch"].iloc[0], "pos": at.astype(np.int32), "shared": total[at]})


def _sets(width: int):
    schema = pa.schema([("fp", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 256):
                some = shingle_sets(b.slice(a, 256).column(0).to_pylist(), width)
                out = [{"fp": fingerprint(s), "n": len(s), "tokens": s.tobytes()} for s in some if len(s)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _postings(num: int, den: int, hot: np.ndarray, level: np.ndarray):
    """(token, fp) of each set's prefix, in the order of (how frequent a hot token is, hash)."""
    schema = pa.schema([("token", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for b in batches:
            for fp, n, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens = np.frombuffer(tokens, np.int64)
                at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                late = np.where(hot[at] == tokens, level[at], 0) if len(hot) else np.zeros(n, np.int8)
                head = tokens[np.argsort(late, kind="stable")[: _prefix(n, num, den)]]
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array([fp] * len(head), pa.binary())], schema=schema)

    return run


EDGES = "a binary, b binary, center binary, apart binary"


def _within(num: int, den: int):
    """Of one chunk: the links that connect its sets; for a block of several chunks, the sets apart from its first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fps, center = rows["fp"].tolist(), rows["center"].iloc[0]
        sets = [np.frombuffer(x, U64) for x in rows["tokens"]]
        first = fps.index(center)
        edges, labels = forest_edges(sets, None, num, den, first)
        out = [(fps[i], fps[j], None, None) for i, j in edges]
        if rows["chunks"].iloc[0] > 1:
            out += [(None, None, center, fps[i]) for i in np.flatnonzero(labels != labels[first])]
        return pd.DataFrame(out, columns=["a", "b", "center", "apart"])

    return run


def _across(num: int, den: int):
    """Of one chunk and some sets apart from the block's first: the links that connect them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, apart = rows[~rows["apart"]], rows[rows["apart"]]
        out = []
        if len(own) and len(apart):
            fps = apart["fp"].tolist() + own["fp"].tolist()
            edges, _ = forest_edges([np.frombuffer(x, U64) for x in apart["tokens"]], [np.frombuffer(x, U64) for x in own["tokens"]], num, den)
            out = [(fps[i], fps[j]) for i, j in edges if fps[i] != fps[j]]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _small(table: DataFrame) -> DataFrame:
    """A written table, broadcast when it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _links(sets: DataFrame, frequent: list, num: int, den: int, chunk: int) -> DataFrame:
    """Edges (a, b) between classes that connect exactly the classes that links connect."""
    frequent = sorted((r["token"], r["texts"]) for r in frequent)
    hot = np.array([t for t, _ in frequent], np.int64)
    level = np.log2([max(1, n) for _, n in frequent]).astype(np.int8) if frequent else np.zeros(0, np.int8)
    postings = sets.select("fp", "n", "tokens").mapInArrow(_postings(num, den, hot, level), "token long, fp binary")
    centers = postings.groupBy("token").agg(F.min("fp").alias("center"), F.count("*").alias("k")).filter("k > 1").drop("k")
    members = materialize(postings.join(centers, "token").select("center", "fp").distinct(), "members")
    # of blocks of several chunks there are few, so a large block's members needn't meet in one task to learn its size
    large = members.groupBy("center").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks")).filter("chunks > 1")
    large = _small(materialize(large, "large-blocks"))
    placed = members.join(large, "center", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn(
        "salt",
        F.when(F.col("fp") == F.col("center"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))),
    )
    placed = placed.select("center", "chunks", F.explode("salt").alias("salt"), "fp")
    block = placed.join(sets, "fp")
    done = materialize(block.groupBy("center", "salt").applyInPandas(_within(num, den), EDGES), "links")
    edges = done.filter("a is not null").select("a", "b")
    apart = done.filter("apart is not null").select("center", F.col("apart").alias("fp"))
    split = _small(materialize(apart.groupBy("center").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts")), "split-blocks"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    whole = placed.filter("chunks > 1").join(split, "center").select("center", "salt", part, "fp", F.lit(False).alias("apart"))
    spread = apart.join(split, "center").join(large, "center")
    spread = spread.select("center", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp", F.lit(True).alias("apart"))
    rest = whole.unionByName(spread).join(sets, "fp").groupBy("center", "salt", "part").applyInPandas(_across(num, den), "a binary, b binary")
    return edges.unionByName(rest)


def jaccard_components(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5, buckets: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, key) for every row of docs (doc_id, text).

    Texts are linked when the Jaccard similarity of their sets of word shingles is num/den or more; component_id is
    the smallest doc_id that links reach. Null and empty texts, and texts of white space, have no shingles and no
    link. Repeated rows come back as often as they came in; a null doc_id takes part in links and never names a
    component unless nothing else is there. component is a binary name of the component itself (null without
    shingles), key the md5 of the text. Other columns are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = 1 << max(5, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))) + 2)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = texts.withColumn("key", F.md5("text"))
    with own_batches(spark):
        seen = materialize(texts.mapInArrow(tidy(_pass_one(width, num, den, buckets)), PASS_ONE), "shingles")
    rows = seen.filter("bucket is null").select("fp", "doc_id", "key", "n", "batch", "pos", "own", "need")
    ranges = seen.filter("bucket is not null").select("bucket", "batch", "tokens", "places").groupBy("bucket")
    counted = materialize(ranges.applyInPandas(_shared_tokens, "batch long, places binary, counts binary"), "counted")
    shared = counted.filter("batch is not null").groupBy("batch").applyInPandas(_summed, "batch long, pos int, shared long")
    tokens = counted.filter("batch is null").select("places", "counts").mapInArrow(_frequent_tokens, "token long, texts long")
    frequent = tokens.orderBy(F.desc("texts"), "token").limit(HOT_TOKENS).collect()  # at most HOT_TOKENS rows
    alive = rows.filter("fp is not null").join(shared, ["batch", "pos"], "left").filter(F.coalesce("shared", F.lit(0)) + F.col("own") >= F.col("need"))
    classes = rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    alive = materialize(alive.select("fp").distinct().join(classes.drop("times"), "fp"), "alive")
    keys, wanted = alive.select(F.col("least").alias("doc_id")).distinct(), alive.select("fp")
    if alive.count() <= BROADCAST_ROWS:
        keys, wanted = F.broadcast(keys), F.broadcast(wanted)
    kept = texts.join(keys, texts["doc_id"].eqNullSafe(keys["doc_id"]), "leftsemi").select("text")
    sets = kept.mapInArrow(tidy(_sets(width)), "fp binary, n long, tokens binary").join(wanted, "fp", "leftsemi")
    with own_batches(spark):
        sets = materialize(sets.dropDuplicates(["fp"]), "sets")
    labels = connected_components(_links(sets, frequent, num, den, chunk))
    named = labels.join(classes, labels["node"] == classes["fp"], "left").select("node", "component", "least")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("node").alias("fp"), "component", "component_id")
    of_class = classes.join(named, "fp", "left").select("fp", "times", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    of_class = materialize(of_class, "classes")
    # the classes with most rows are broadcast, so the rows of the others spread over the shuffle
    hot = F.broadcast(of_class.filter(F.col("times") > HOT_ROWS).orderBy(F.desc("times"), "fp").limit(HOT_CLASSES).drop("times"))
    worded = rows.filter("fp is not null").select("fp", "doc_id", "n", "key")
    cold = worded.join(hot.select("fp"), "fp", "leftanti").join(of_class.drop("times"), "fp", "left")
    bare = rows.filter("fp is null").select("fp", "doc_id", "n", "key", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    out = cold.unionByName(worded.join(hot, "fp")).unionByName(bare)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component", "key")


def first_of_components(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, without those that link to a kept one: of each component the row
    with the smallest doc_id (null last; then the smallest md5 of its text) stays. Texts without words all stay. Of
    rows with one doc_id and one text, any one stays. docs may have columns of any other names."""
    rows = materialize(jaccard_components(docs, num, den, width), "rows").filter("component is not null")
    each = rows.groupBy("component", "doc_id", "key").agg(F.count("*").alias("times"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    each = materialize(each.join(first, "component").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))), "kept")
    gone, again = each.filter("not kept"), each.filter("kept and times > 1")

    def on(table: DataFrame):
        keys = table.select("doc_id", "key")
        keys = F.broadcast(keys) if table.count() <= BROADCAST_ROWS else keys
        return keys, docs["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (F.md5(docs["text"].cast("binary")) == keys["key"])

    left = docs.join(*on(gone), "leftanti")
    if again.isEmpty():
        return left
    once = docs.join(*on(again), "leftsemi").dropDuplicates(["doc_id", "text"])
    return left.join(*on(again), "leftanti").unionByName(once)
