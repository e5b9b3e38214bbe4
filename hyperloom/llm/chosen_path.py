"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles, five consecutive words each (all words, if
fewer). Equal sets form a class, found by a digest; one member stands for it. A set is
embedded as ``COORDINATES`` minhashes, so that two sets agree in a coordinate with the
probability of their similarity.

Each run is a tree that splits the representatives recursively: a node picks
``PICKS`` coordinates, and a set goes to one child per pick, named by its value there, so
a similar pair shares a chosen token at every level with high probability while
others part. With threshold 0.8 a pair misses one level with probability 0.2**2 at
most. Recursion ends in small buckets, in buckets that no longer split (they are dense:
their members agree almost everywhere), or at ``DEPTH``.

Runs come in rounds of ``RUNS`` and repeat until the target recall: the share of a round's
runs that find a pair, over all pairs found, tells the chance of one run to find a pair
(the pairs that none found are allowed for), and that the recall of all runs so far. Further
rounds follow until it reaches ``RECALL``.

Buckets are brute-forced exactly, on whole shingle sets. A large bucket is dealt over a
grid of blocks, so none is capped and no task holds more than two blocks. Before that,
small buckets lose members that agree with no other in ``LEAST_AGREE`` coordinates, which
befalls a pair at the threshold once in a billion times, and buckets with the same members
are joined once. A pair that shares several buckets is counted in the first. A bucket
reports links per member and a star per component, not pairs, so a group of n near
copies makes n rows.

Result, one row per input row: class_id, the smallest id of the connected component of
links (equal texts included); copy_of, the smallest id with the same set; n_links, the
other sets at or above the threshold; n_linked_docs, the documents that have them.

A document is a row, whatever its id: rows that share an id are told apart by their texts,
and rows without an id take part, too (an id is null where no row of the class or set has
one; null ids sort last). Ids may have any type that sorts. Texts that are null or without
words have no shingles and stand alone. An empty table gives an empty result; extra columns
are ignored. A text is shingled whole; a set of very many shingles meets ``BLOCK`` others at
most in one task, and its minhashes are worked out a stretch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, bounds_of, components, cut, landed, runs_of, ship

WORDS = re.compile(WORD)
SHINGLE = 5
COORDINATES = 64
RUNS, PICKS, DEPTH = 4, 2, 4
RECALL, MOST_ROUNDS = 0.999, 8
SMALL = 32
BLOCK = 256
#: Of 64 coordinates, a pair of similarity 0.8 agrees in fewer with a probability of about 1e-9.
LEAST_AGREE = 31
REMEMBER = 500_000
_RNG = np.random.default_rng(20240601)
_FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_PLACES = _RNG.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        import xxhash

        seen = self.seen
        if len(seen) > REMEMBER:
            seen.clear()
        hashes = []
        for w in WORDS.findall(text) if text else ():
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w.encode())
            hashes.append(h)
        x = np.array(hashes, dtype=np.uint64)
        if not len(x):
            return x
        k = min(SHINGLE, len(x))
        out = np.full(len(x) - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            out += mixed(x[j : len(x) - k + 1 + j] * _PLACES[j] + _PLACES[SHINGLE])
        return np.unique(mixed(out))


def minhashes(x: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**32 - 1, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        part = (x[None, lo : lo + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]) >> np.uint64(32)
        low = np.minimum(low, part.min(1).astype(np.uint32))
    return low


def digest(x: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(x.tobytes())


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> doc_id, h, n, cls, sig."""
    shingles = Shingler()
    for batch in batches:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        made = [pa.array([len(x) for x in sets], pa.int32()), pa.array([digest(x) for x in sets], pa.binary()), pa.array([minhashes(x).tobytes() if len(x) else None for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "h", "n", "cls", "sig"])


def children(paths: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """Per row and pick, the child's path: the node's path picks the coordinates, the set its value there."""
    out = np.empty((len(paths), PICKS), dtype=np.uint64)
    first = mixed(paths) % np.uint64(COORDINATES)
    step = mixed(paths ^ np.uint64(0x5555)) % np.uint64(COORDINATES - 1)
    for p in range(PICKS):
        spot = (first + np.uint64(p) * (step + np.uint64(1))) % np.uint64(COORDINATES)
        value = sigs[np.arange(len(paths)), spot.astype(np.int64)].astype(np.uint64)
        out[:, p] = mixed(mixed(paths + spot + np.uint64(1)) ^ value)
    return out


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, COORDINATES)


def roots(runs: range) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sigs = signatures(frame["sig"])
                for r in runs:
                    kids = children(np.full(len(frame), mixed(np.array([r + 1], dtype=np.uint64))[0]), sigs).view(np.int64)
                    yield pd.DataFrame({"path": kids.ravel(), "rep": np.repeat(frame["rep"].to_numpy(), PICKS), "run": np.int32(r)})

    return grow


def branches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            kids = children(frame["path"].to_numpy().view(np.uint64), signatures(frame["sig"])).view(np.int64)
            yield pd.DataFrame({"path": kids.ravel(), **{c: np.repeat(frame[old].to_numpy(), PICKS) for c, old in (("rep", "rep"), ("run", "run"), ("up", "n"))}})


def labels_of(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def thinned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small buckets, split into groups that may hold links; members without any are left out."""
    for frame in runs_of(frames, ["path"]):
        sigs, paths, reps, runs = signatures(frame["sig"]), frame["path"].to_numpy(), frame["rep"].to_numpy(), frame["run"].to_numpy()
        leaf, at = [], []
        for a, b in bounds_of(frame, ["path"]):
            near = (sigs[a:b, None, :] == sigs[None, a:b, :]).sum(2) >= LEAST_AGREE
            np.fill_diagonal(near, False)
            label = labels_of(near)
            for k in np.flatnonzero(near.any(1)):
                leaf.append(int(paths[a]) ^ (int(label[k]) << 1))
                at.append(a + int(k))
        at = np.array(at, dtype=np.int64)
        yield pd.DataFrame({"leaf": np.array(leaf, dtype=np.int64), "rep": reps[at], "run": runs[at]})


def leaves(reps: DataFrame, runs: range) -> DataFrame:
    """leaf, rep, run: the buckets in which the trees of some runs end."""
    n_all = reps.count()
    level = reps.select("rep", "sig").mapInPandas(roots(runs), "path long, rep long, run int").withColumn("up", F.lit(n_all).cast("long"))
    small, large = [], []
    for depth in range(1, DEPTH + 1):
        # the sizes are cut off their counting, so that the join reads plain partitions, which adaptive execution splits where a path is hot
        sizes = cut(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        level = cut(level.join(sizes, "path"))
        ends = (F.col("n") <= SMALL) | (F.col("n") * 2 > F.col("up")) | F.lit(depth == DEPTH)
        small.append(level.where(F.col("n") <= SMALL).select("path", "rep", "run"))
        large.append(level.where(ends & (F.col("n") > SMALL)).select(F.col("path").alias("leaf"), "rep", "run"))
        level = level.where(~ends)
        if level.isEmpty():
            break
        level = level.join(reps.select("rep", "sig"), "rep").select("path", "rep", "run", "n", "sig").mapInPandas(branches, "path long, rep long, run int, up long")
    few = small[0]
    for x in small[1:]:
        few = few.union(x)
    few = few.join(reps.select("rep", "sig"), "rep").repartition("path").sortWithinPartitions("path", "rep")
    out = few.select("path", "rep", "run", "sig").mapInPandas(thinned, "leaf long, rep long, run int")
    for x in large:
        out = out.union(x)
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by column blocks of the incidence matrix."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1
    row, col = row[often], col[often]
    if len(col):
        col = np.cumsum(np.concatenate([[True], col[1:] != col[:-1]])) - 1
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of a bucket's block pair: links per member and a star per component; on the first row, how many pairs were counted and in how many runs each was found."""
    keys = ["leaf", "i", "j"]
    for frame in runs_of(frames, keys):
        out = []
        for a, b in bounds_of(frame, keys):
            part = frame.iloc[a:b]
            part = part[~part["rep"].duplicated()]
            leaf, i, j = (int(part[k].iloc[0]) for k in keys)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
            block, copies, reps = part["block"].to_numpy(), part["copies"].to_numpy(), part["rep"].to_numpy()
            both = shared_counts(sets)
            size = np.array([len(s) for s in sets])
            linked = both * 5 >= 4 * (size[:, None] + size[None, :] - both)
            linked &= reps[:, None] != reps[None, :]
            if i != j:
                linked &= block[:, None] != block[None, :]
            known = {int(x): n for n, x in enumerate({x["leaf"] for own in part["leaves"] for x in own})}
            member, runs = np.zeros((len(sets), len(known)), dtype=np.float32), np.zeros(len(known), dtype=np.int64)
            for n, own in enumerate(part["leaves"]):
                for x in own:
                    k = known[int(x["leaf"])]
                    member[n, k] = 1
                    runs[k] |= x["runs"]
            earlier = member[:, np.array([x < leaf for x in known])]
            counted = linked & (earlier @ earlier.T == 0)
            pairs = finds = 0
            if counted.any():
                times = np.zeros(counted.shape, dtype=np.int64)
                for r in range(int(runs.max()).bit_length()):
                    own = member[:, (runs >> r) & 1 == 1]
                    times += own @ own.T > 0
                pairs, finds = int(counted.sum()) // 2, int(times[counted].sum()) // 2
            label = labels_of(linked)
            has = linked.any(1)
            docs = counted @ copies
            low: dict[int, int] = {}
            for n in np.flatnonzero(has):
                low[label[n]] = min(low.get(label[n], reps[n]), reps[n])
            for n in np.flatnonzero(has):
                out.append((reps[n], int(counted[n].sum()), int(docs[n]), low[label[n]], pairs, finds))
                pairs = finds = 0
        yield pd.DataFrame(out, columns=["rep", "n_links", "n_linked_docs", "root", "pairs", "finds"])


def shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to shingle sets; of rows that agree in id and text, which lie side by side, the first is taken."""
    shingles, last = Shingler(), None
    for frame in frames:
        reps = frame["rep"].to_numpy()
        new = np.concatenate([[last is None or reps[0] != last], reps[1:] != reps[:-1]]) if len(reps) else np.zeros(0, dtype=bool)
        frame = frame[new]
        last = reps[-1] if len(reps) else last
        yield frame.drop(columns=["text"]).assign(shingles=[shingles(t).tobytes() for t in frame["text"]])


LEAVES = "array<struct<leaf:long,runs:long,m:long>>"


def linked(buckets: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """rep, n_links, n_linked_docs, root, pairs, finds: what the buckets' exact comparison finds."""
    once = cut(
        buckets.groupBy("leaf").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.bit_or(F.expr("shiftleft(1L, run)")).alias("runs"))
        .groupBy("m", "who").agg(F.min("leaf").alias("leaf"), F.bit_or("runs").alias("runs"))
    )
    own = buckets.select("leaf", "rep").join(once.select("leaf", "m", "runs"), "leaf").groupBy("rep").agg(F.collect_list(F.struct("leaf", "runs", "m")).alias("leaves"))
    # the row that gives a class its text is fixed by id and text, so all that agree in both hold the same text
    own = own.join(reps.select("rep", "copies", "low.h", id_key(F.col("low.doc_id"))), "rep")
    sets = rows.join(own, ["h", "id_key"]).select("rep", "copies", "leaves", "text").mapInPandas(shingled, f"rep long, copies long, leaves {LEAVES}, shingles binary")
    grid = sets.select("rep", "copies", "leaves", "shingles", F.explode("leaves").alias("at")).select("rep", "copies", "leaves", "shingles", "at.leaf", F.ceil(F.col("at.m") / BLOCK).cast("int").alias("blocks"))
    grid = grid.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = grid.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "leaves", "shingles")
    return grid.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "rep").mapInPandas(brute, "rep long, n_links long, n_linked_docs long, root long, pairs long, finds long")


def recall_of(pairs: int, finds: int, runs: int) -> float:
    """The recall of ``runs`` runs that found ``pairs`` pairs, each in finds / pairs of them on average: at least one run has found each, which raises that average."""
    if not pairs or finds >= pairs * runs:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if p * runs / (1 - (1 - p) ** runs) < finds / pairs else (low, p)
    return 1 - (1 - low) ** runs


def found_until(reps: DataFrame, rows: DataFrame, recall: float = RECALL) -> tuple[DataFrame, float, int]:
    """Links by as many rounds of runs (two of them or more each) as the recall asks for; the recall reached, and the runs."""
    buckets, runs = None, 0
    while True:
        more = cut(leaves(reps, range(runs, runs + RUNS)))
        buckets, runs = more if buckets is None else buckets.union(more), runs + RUNS
        found = cut(linked(buckets, reps, rows))
        pairs, finds = found.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("finds"), F.lit(0))).first()
        reached = recall_of(pairs, finds, runs)
        if reached >= recall or runs >= RUNS * MOST_ROUNDS:  # a run finds a pair with 0.85 at least, so the second never ends it
            return found, reached, runs


def id_key(doc_id: Column) -> Column:
    """An id as text, null told apart from all others."""
    return F.coalesce(F.concat(F.lit("s"), doc_id.cast("string")), F.lit("n")).alias("id_key")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("h")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, h (digest of the text), n (shingles), class_id, class_h (digest of the row that class_id names), copy_of, n_links, n_linked_docs. All but the first three are null for texts without words."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    every = landed(rows.mapInArrow(sketches, f"doc_id {kind}, h binary, n int, cls binary, sig binary"), "sketches")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))).alias("low")
    reps = every.where("n > 0").groupBy("cls", "n").agg(low, F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = landed(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    found, _, _ = found_until(reps, rows.select(id_key(F.col("doc_id")), "h", "text"), recall)
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"))
    parts = cut(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    names = cut(parts.join(reps.select("rep", "low"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("low").alias("name")))
    parts = parts.join(names, "component").select(F.col("node").alias("rep"), "name")
    zero = F.lit(0).cast("long")
    known = reps.select("cls", "n", "rep", "low").join(links, "rep", "left").join(parts, "rep", "left").withColumn("name", F.coalesce("name", "low"))
    known = known.select("cls", "n", F.col("name.doc_id").alias("class_id"), F.col("name.h").alias("class_h"), F.col("low.doc_id").alias("copy_of"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_linked_docs", zero).alias("n_linked_docs"))
    return every.select("doc_id", "h", "n", "cls").join(known, ["cls", "n"], "left").drop("cls")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_of, n_links, n_linked_docs."""
    out = classes(docs, doc_id, text, recall)
    own = lambda c, other: F.when(F.col("n") == 0, other).otherwise(F.col(c)).alias(c)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", own("class_id", F.col("doc_id")), own("copy_of", F.col("doc_id")), own("n_links", zero), own("n_linked_docs", zero))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked texts, with all its columns: that of the smallest id, of rows with that id the one with the smallest digest of its text. Texts without words all stay."""
    found = classes(docs, doc_id, text)
    gone = found.where((F.col("n") > 0) & ~(F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("class_h") == F.col("h")))).select(id_key(F.col("doc_id")), "h")
    gone = landed(gone.distinct(), "gone")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), id_key(F.col(doc_id)), digest_of(F.col(text)), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("has_words"))
    # rows that agree in id and text are one, but for those without words, which get a key of their own each
    whole = whole.withColumn("lone", F.when(~F.col("has_words"), F.monotonically_increasing_id()))
    left = whole.join(gone, ["h", "id_key"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("h", "id_key", "lone").orderBy("has_words"))
    return left.withColumn("nth", nth).where("nth = 1").select("whole.*")
