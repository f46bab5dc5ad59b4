"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document's ids are cut into pieces of a sequence's length; a whole piece is a sequence of its own, so only last pieces
are packed. They are dealt by hash to blocks of about BLOCK pieces. A block is solved on several islands: each one keeps
a small population of packings. A crossover takes over the other parent's well-filled bins whole, drops the own bins that
hold any of their pieces, and puts the displaced pieces where they fit best, longest first. After each epoch the best
packing of an island moves on to the next island of its block. A block whose best packing has as many bins as its pieces
need at least is done, by proof. The emptiest bins of all blocks are then opened and packed together once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisa.llm.encoders import WordEncoder
from decisa.llm.words import CACHES, groups, release_caches, tidy
from decisa.session import materialize, own_batches

LENGTH = 2048
#: Pieces of a block on average, islands of a block, packings of an island, epochs between migrations and crossovers of
#: an island in one.
BLOCK, ISLANDS, POPULATION, EPOCHS, CROSSOVERS = 8192, 3, 4, 3, 6
#: The share of a block's bins, the emptiest ones, that are opened for the second packing.
OPENED = 0.02

_encoders: dict[str, WordEncoder] = {}
CACHES.append(_encoders)


def pieces_of(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_key, piece, start, length, ids_crc32, ids): each text's ids and an id 0, in pieces of at most `length`.

    tokenizer_path is a tokenizers file that drops white space. A null text is empty: one piece of one id. piece_key is a
    number of its own for each piece while the table isn't computed anew."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        encode, at = _encoders[tokenizer_path], TaskContext.get().partitionId() << 36
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in groups(texts, 1 << 19):
                ids = [np.append(x, np.zeros(1, np.uint32)).astype("<u4") for x in encode(texts[low:high])]
                owner, piece, start, size, crc, data = [], [], [], [], [], []
                for i, x in enumerate(ids):
                    for k, begin in enumerate(range(0, len(x), length)):
                        part = x[begin : begin + length].tobytes()
                        owner.append(low + i)
                        piece.append(k)
                        start.append(begin)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        data.append(part)
                number = np.arange(at, at + len(owner))
                at += len(owner)
                columns = [pa.array(number), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, size, crc)], pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *columns], names=["key", "piece_key", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run, _encoders), f"key {key_type}, piece_key long, piece int, start long, length long, ids_crc32 long, ids binary")


def fewest(sizes: np.ndarray, length: int) -> int:
    """A number of bins that no packing can fall below: by the sum of sizes, and by those that can't share a bin, with
    what the smaller ones need beside them, for every border between large and small."""
    sizes = np.sort(sizes.astype(np.int64))
    least = -(-int(sizes.sum()) // length)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    for k in np.unique(sizes[sizes * 2 <= length]).tolist() + [length // 2 + 1]:
        large = np.searchsorted(sizes, length - k, "right")  # sizes above length - k
        middle = np.searchsorted(sizes, length // 2, "right")
        large = max(large, middle)
        small = np.searchsorted(sizes, k, "left")
        need = int(upto[middle] - upto[min(small, middle)])
        free = (large - middle) * length - int(upto[large] - upto[middle])
        least = max(least, len(sizes) - middle + max(0, -(-(need - free) // length)))
    return least


class Bins:
    """Bins under best fit: the fullest bin with room for a piece takes it."""

    def __init__(self, length: int, loads: list[int]):
        self.length, self.loads = length, loads
        self.by_room: list[list[int]] = [[] for _ in range(length + 1)]
        self.rooms = 0  # bit r: some bin has room r
        for i, load in enumerate(loads):
            self._put(i, length - load)

    def _put(self, i: int, room: int) -> None:
        self.by_room[room].append(i)
        self.rooms |= 1 << room

    def place(self, size: int) -> int:
        fits = self.rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            same = self.by_room[room]
            i = same.pop()
            if not same:
                self.rooms ^= 1 << room
        else:
            i, room = len(self.loads), self.length
            self.loads.append(0)
        self.loads[i] += size
        if room > size:
            self._put(i, room - size)
        return i


def best_fit(sizes: np.ndarray, length: int, order: np.ndarray, bin_of: np.ndarray, loads: list[int]) -> np.ndarray:
    """bin_of with the pieces of `order` put where they fit best, one after another; loads grows with new bins."""
    bins = Bins(length, loads)
    bin_of[order] = [bins.place(s) for s in sizes[order].tolist()]
    return bin_of


def _loads(bin_of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, weights=sizes).astype(np.int64)


def fitness(bin_of: np.ndarray, sizes: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer bins are better, then bins that are fuller than others."""
    loads = _loads(bin_of, sizes)
    return -len(loads), float(((loads / length) ** 2).mean())


def crossover(mine: np.ndarray, other: np.ndarray, sizes: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """`mine` with some of the other's well-filled bins: own bins with any of their pieces go, and what else was in these
    is put where it fits best, longest first; so is what was in a few of the emptiest bins."""
    loads = _loads(other, sizes)
    full = np.argsort(-loads, kind="stable")[: max(1, len(loads) // 2)]
    taken = np.zeros(len(loads), bool)
    taken[rng.choice(full, max(1, len(full) // 3), replace=False)] = True
    injected = taken[other]
    own = _loads(mine, sizes)
    gone = np.zeros(len(own), bool)
    gone[mine[injected]] = True
    gone[np.argsort(own, kind="stable")[: max(1, len(own) // 50)]] = True
    kept = ~injected & ~gone[mine]
    child = np.empty(len(sizes), np.int64)
    names, place = np.unique(np.concatenate([mine[kept], other[injected] + len(own)]), return_inverse=True)
    child[np.concatenate([np.flatnonzero(kept), np.flatnonzero(injected)])] = place
    rest = np.flatnonzero(~kept & ~injected)
    here = np.bincount(place, weights=sizes[np.concatenate([np.flatnonzero(kept), np.flatnonzero(injected)])], minlength=len(names)).astype(np.int64)
    return best_fit(sizes, length, rest[np.argsort(-sizes[rest], kind="stable")], child, here.tolist())


def founders(sizes: np.ndarray, length: int, count: int, rng: np.random.Generator, exact: bool) -> list[np.ndarray]:
    """First packings: best fit by falling size, then by sizes with more and more noise."""
    out = []
    for k in range(count):
        noise = 0 if exact and k == 0 else 0.02 * (k + 1)
        order = np.argsort(-sizes * (1 + noise * rng.random(len(sizes))), kind="stable")
        out.append(best_fit(sizes, length, order, np.empty(len(sizes), np.int64), []))
        if k == 0 and exact and len(np.unique(out[0])) == fewest(sizes, length):
            break
    return sorted(out, key=lambda p: fitness(p, sizes, length), reverse=True)


def evolve(population: list[np.ndarray], sizes: np.ndarray, length: int, crossovers: int, least: int, rng: np.random.Generator, keep: int) -> list[np.ndarray]:
    """The best `keep` packings after some crossovers of two chosen ones; it ends early at a packing with `least` bins."""
    scored = sorted(((fitness(p, sizes, length), k, p) for k, p in enumerate(population)), key=lambda s: s[:2], reverse=True)
    for k in range(crossovers):
        if -scored[0][0][0] <= least or len(scored) < 2:
            break
        x, y = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[x][2], scored[y][2], sizes, length, rng)
        scored.append((fitness(child, sizes, length), len(population) + k, child))
        scored = sorted(scored, key=lambda s: s[:2], reverse=True)[:keep]
    return [p for _, _, p in scored]


ISLAND = "block long, island int, least int, bins int, keys binary, sizes binary, packings array<binary>"


def _island_rows(block: int, island: int, least: int, keys: np.ndarray, sizes: np.ndarray, packings: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([{"block": block, "island": island, "least": least, "bins": len(np.unique(packings[0])), "keys": keys.astype("<i8").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "packings": [p.astype("<i4").tobytes() for p in packings]}])


def _read(row) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.frombuffer(row.sizes, "<i4").astype(np.int64), [np.frombuffer(p, "<i4").astype(np.int64) for p in row.packings]


def _pack_blocks(pieces: DataFrame, length: int, islands: int, population: int, epochs: int, crossovers: int, name: str) -> DataFrame:
    """ISLAND rows, one a block: the best packing found. pieces: (block, piece_key, length). bins counts an island's first
    packing, its best."""

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        release_caches()  # the worker may hold an encoder
        pdf = pdf.sort_values("piece_key")
        keys, sizes = pdf["piece_key"].to_numpy(), pdf["length"].to_numpy(np.int64)
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        rng = np.random.default_rng([block % (1 << 32), island])
        return _island_rows(block, island, fewest(sizes, length), keys, sizes, founders(sizes, length, population, rng, island == 0))

    def epoch(number: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            """One block's islands: each takes in the best packing of the one before it and goes on for itself."""
            rows = list(pdf.sort_values("island").itertuples())
            read = [_read(r) for r in rows]
            best = [max(p, key=lambda q: fitness(q, s, length)) for s, p in read]
            out = []
            for k, (row, (sizes, packings)) in enumerate(zip(rows, read, strict=True)):
                rng = np.random.default_rng([row.block % (1 << 32), row.island, number])
                arrived = [*packings, best[k - 1]] if len(rows) > 1 else packings
                out.append(_island_rows(row.block, row.island, row.least, np.frombuffer(row.keys, "<i8"), sizes, evolve(arrived, sizes, length, crossovers, row.least, rng, population)))
            return pd.concat(out)

        return run

    first = materialize(pieces.withColumn("island", F.lit(0)).groupBy("block", "island").applyInPandas(start, ISLAND), f"{name}-0")
    done, still = first.filter("bins <= least"), first.filter("bins > least")
    if epochs == 0 or islands < 1 or still.isEmpty():
        return first
    rest = pieces.join(still.select("block"), "block", "left_semi").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(1, islands)]))) if islands > 1 else None
    state = still if rest is None else still.unionByName(rest.groupBy("block", "island").applyInPandas(start, ISLAND))
    state = materialize(state, f"{name}-1")
    for number in range(epochs):
        state = materialize(state.groupBy("block").applyInPandas(epoch(number), ISLAND), f"{name}-{number + 2}")
    best = state.groupBy("block").agg(F.min_by(F.struct(*state.columns), F.struct("bins", "island")).alias("s")).select("s.*")
    return done.unionByName(best)


PLACE = "piece_key long, sequence_id long, offset long, opened boolean"


def _places(islands: DataFrame, length: int, opened: float) -> DataFrame:
    """(piece_key, sequence_id, offset, opened) of the packings' pieces; a share of each block's bins, the emptiest, are
    marked as opened, unless they are full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_caches()
        for pdf in batches:
            for row in pdf.itertuples():
                sizes, packings = _read(row)
                keys, bin_of = np.frombuffer(row.keys, "<i8"), packings[0]
                loads = _loads(bin_of, sizes)
                order = np.lexsort((keys, bin_of))
                upto = np.cumsum(sizes[order]) - sizes[order]
                begins = np.concatenate(([0], np.cumsum(loads)[:-1]))
                emptiest = np.zeros(len(loads), bool)
                emptiest[np.argsort(loads, kind="stable")[: int(np.ceil(opened * len(loads)))]] = True
                some = bin_of[order]
                yield pd.DataFrame({"piece_key": keys[order], "sequence_id": (row.block << 32) + some, "offset": upto - begins[some], "opened": (emptiest & (loads < length))[some]})

    return islands.mapInPandas(run, PLACE)


def pack(pieces: DataFrame, length: int = LENGTH, block: int = BLOCK, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, crossovers: int = CROSSOVERS) -> DataFrame:
    """(piece_key, sequence_id, offset) of every row of pieces (piece_key, length), whose lengths are 1 to `length`.

    Pieces of whole length are sequences of their own. sequence_id is a number without meaning; pieces lie gapless in it
    from offset 0. An empty table gives none. The result is the same for the same keys and lengths."""
    whole = pieces.filter(F.col("length") == length).select("piece_key", (-F.col("piece_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < length).select("piece_key", "length")
    settings = (length, islands, population, epochs, crossovers)

    def dealt(rows: DataFrame, lead: int) -> DataFrame:
        """Rows in blocks, by a hash of their key, whose numbers begin at lead."""
        n = max(1, round(rows.count() / block))
        return rows.select((F.lit(lead) + F.pmod(F.xxhash64("piece_key"), F.lit(n))).alias("block"), "piece_key", "length")

    first = materialize(_places(_pack_blocks(dealt(rest, 0), *settings, "islands"), length, OPENED), "places")
    again = materialize(first.filter("opened").select("piece_key").join(rest, "piece_key"), "opened")
    second = _places(_pack_blocks(dealt(again, 1 << 28), *settings, "islands-again"), length, 0.0)
    placed = first.filter(~F.col("opened")).unionByName(second)
    return whole.unionByName(placed.select("piece_key", "sequence_id", "offset"))


def packed(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset, ids): every piece of every whole text, and its place.

    See pieces_of() and pack(). Rows of equal keys are documents of their own. Columns beside key and text aren't read.
    The pieces, with their ids, are written to the shared folder once and joined to their places."""
    with own_batches(docs.sparkSession):
        pieces = materialize(pieces_of(docs, tokenizer_path, length, key, text), "pieces")
    out = pieces.join(pack(pieces.select("piece_key", "length"), length, **settings), "piece_key")
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed() rows: each sequence's ids in the order of their offsets, as bytes. A
    sequence is one row of at most the packed length."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, part))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
