"""Conversation repair by shortest paths with a bucket queue (Dial).

A conversation is good if its roles' initials read ``(s?(ua)+)?``. Its rows are edited to become so:
Keep (0), Rerole to user or assistant (2), Delete (3, required for blank and repeated rows), Insert an
empty turn anywhere (2); a truncated row that stays costs 1 more. Nodes of the graph are (rows read, state):
nothing said yet, after system, after user, after assistant. All costs are whole numbers up to 3, so a
circular array of four buckets settles the nodes in order of distance to the end without a heap.
With the distances recorded, the walk from the start takes, of the tight arcs (cost plus distance ahead
equals the own distance), the one with the least letter; the letters are the audit, the least of all cheapest ones.

Rows are sorted and dealt by range of (conversation, turn, role, text), so a conversation of any length spreads over
tasks. A conversation inside one task is repaired there. One that touches a task's edge or has more than ``SEGMENT`` rows
goes in segments: each gives the 4 x 4 least costs from its first to its last state (four runs of the queue), these compose to
the distances at the segments' ends, then each segment walks from every state, the walks compose, and each row
learns its edit. What meets per conversation is one row per segment; texts pass through the digest as a stream.

Nulls: a null role or text is one blank; null turns come first; null ids form one conversation. Rows of one turn are ordered by role,
by the text's first ``HEAD`` characters, then by digest; repeated rows are duplicates. Empty tables give an empty result;
columns not named are ignored. An empty text is blank; a text is only read for its last characters and in the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import landed, ship

KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
WIDTH = 4  # buckets: one more than the dearest arc
#: States, what leads to each by a role's initial, and the role that may come next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
BEFORE = {q: [p for p in range(4) if NEXT[p, WANTED[p][0]] == q] for q in range(4)}
ENDS = {START: 0, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
SEGMENT = 4096
HEAD = 100
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3

Row = tuple[str, int]  # initial of the role, fault
Distances = list[list[int | None]]


def distances(rows: list[Row], ends: dict[int, int]) -> Distances:
    """Cost from each node (rows read, state) to the end, where state q has ``ends[q]`` ahead of it; None: no way."""
    dist: Distances = [[None] * 4 for _ in range(len(rows) + 1)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(WIDTH)]
    due = sorted(((d, q) for q, d in ends.items()), reverse=True)
    clock, waiting = 0, 0
    while due or waiting:
        if not waiting:
            clock = max(clock, due[-1][0])
        while due and due[-1][0] == clock:
            buckets[clock % WIDTH].append((len(rows), due.pop()[1]))
            waiting += 1
        bucket = buckets[clock % WIDTH]
        while bucket:  # arcs of cost 0 fall into the same bucket
            i, q = bucket.pop()
            waiting -= 1
            if dist[i][q] is not None:
                continue
            dist[i][q] = clock
            arcs = [(i, p, INSERT) for p in BEFORE[q]]
            if i:
                initial, fault = rows[i - 1]
                arcs.append((i - 1, q, DELETE))
                if fault not in (BLANK, DUPLICATE):
                    more = TRUNCATED if fault == CUT_OFF else 0
                    arcs += [(i - 1, p, KEEP + more) for p in range(4) if NEXT.get((p, initial)) == q]
                    arcs += [(i - 1, p, REROLE + more) for p in BEFORE[q]]
            for j, p, cost in arcs:
                if dist[j][p] is None:
                    buckets[(clock + cost) % WIDTH].append((j, p))
                    waiting += 1
        clock += 1
    return dist


def walk(rows: list[Row], dist: Distances, q: int, last: bool) -> tuple[list[tuple[int, str, str]], int]:
    """The least cheapest edits from state q: (row, letter, role it sets), and the state behind the last row.

    Only the last segment inserts behind its rows; elsewhere the next segment's start is the same place.
    """
    i, steps = 0, []
    while not (i == len(rows) and (not last or dist[i][q] == 0)):
        d, wanted = dist[i][q], WANTED[q]
        to = NEXT[q, wanted[0]]
        tight = lambda j, p, cost, d=d: dist[j][p] is not None and dist[j][p] + cost == d
        if i < len(rows):
            initial, fault = rows[i]
            stays, more = fault not in (BLANK, DUPLICATE), TRUNCATED if fault == CUT_OFF else 0
            kept = NEXT.get((q, initial))
            if tight(i + 1, q, DELETE):
                steps.append((i, "D", ""))
                i += 1
                continue
            if not tight(i, to, INSERT):
                letter, q = ("K", kept) if stays and kept is not None and tight(i + 1, kept, KEEP + more) else ("R", to)
                steps.append((i, letter, "" if letter == "K" else wanted))
                i += 1
                continue
        steps.append((i, "I", wanted))
        q = to
    return steps, q


def crossed(rows: Iterable[Row]) -> int:
    """Neighbours whose initials may not follow one another."""
    initials = [r[0] for r in rows]
    return sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))


def lines(step: tuple[int, str, str], roles: list[str], texts: list[str]) -> str | None:
    i, letter, role = step
    if letter == "D":
        return None
    return f"{role}:" if letter == "I" else f"{role or roles[i]}:{texts[i]}"


class Digest:
    """Lines joined by line breaks, as they come."""

    def __init__(self) -> None:
        self.sha, self.some = hashlib.sha256(), False

    def add(self, line: str | None) -> None:
        if line is not None:
            self.sha.update(("\n" if self.some else "").encode() + line.encode())
            self.some = True


RESULT = "key string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, repaired_sha256 string"
PASSED = RESULT + ", seg long, n int, initial string, fault int, role string, text string"
TURNS = "key string, seg long, n int, k int, edit string, role string, text string"


def _count(faults: list[int]) -> tuple[int, int, int]:
    return tuple(faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF))


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bool, list[Row], list[str], list[str]]]:
    """Runs of rows of one conversation in a sorted partition, of ``SEGMENT`` rows at most, and whether they are all of it."""
    key, first, parts = None, True, 0
    rows: list[Row] = []
    roles: list[str] = []
    texts: list[str] = []
    for frame in frames:
        for k, role, text, fault in zip(frame["key"], frame["role"], frame["text"], frame["fault"].tolist(), strict=True):
            if rows and (k != key or len(rows) == SEGMENT):
                yield key, k != key and not first and not parts, rows, roles, texts
                first, parts = first and k == key, parts + 1 if k == key else 0
                rows, roles, texts = [], [], []
            key = k
            rows.append((role[:1], fault))
            roles.append(role)
            texts.append(text)
    if rows:
        yield key, False, rows, roles, texts


def _edited(rows: list[Row], roles: list[str], texts: list[str]) -> tuple:
    dist = distances(rows, ENDS)
    steps, _ = walk(rows, dist, START, True)
    digest = Digest()
    for s in steps:
        digest.add(lines(s, roles, texts))
    return crossed(rows), *_count([f for _, f in rows]), dist[0][START], "".join(s[1] for s in steps), digest.sha.hexdigest()


def _turns(key: str, seg: int, rows: list[Row], roles: list[str], texts: list[str], dist: Distances, entry: int, last: bool, at: list[int] | None = None) -> list[tuple]:
    """A row per edit: n is the row's place, k the edit's place at it."""
    out, before, k = [], -1, 0
    for i, letter, role in walk(rows, dist, entry, last)[0]:
        k = k + 1 if i == before else 0
        before = i
        said = (None, None) if letter == "D" else (role, "") if letter == "I" else (role or roles[i], texts[i])
        out.append((key, seg, i, k, letter, *said))
    return out


def faulty(rows: DataFrame, key: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """key, turn, role, text, said (a digest of role and text), id, fault: 0, or what is wrong with the row first. Written to the shared folder."""
    rows = rows.select(key.alias("key"), turn.alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = landed(rows.select("*", said.alias("said"), tail.alias("tail"), F.monotonically_increasing_id().alias("id")), "turns")
    nth = F.struct(F.col("turn").isNotNull(), "turn", "id")
    repeated = rows.groupBy("key", "said").agg(F.min(nth).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    marked = rows.join(repeated, ["key", "said"], "left").withColumn("again", F.col("first").isNotNull() & (nth > F.col("first")))
    fault = F.when(F.col("tail") == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.col("tail").isin(".", "!", "?"), CUT_OFF).otherwise(0)
    return marked.select("key", "turn", "role", "text", "said", "id", fault.alias("fault"))


def _dealt(marked: DataFrame) -> DataFrame:
    order = ["key", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, HEAD), "said", "id"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "role", "text", "fault")


def _passed(marked: DataFrame, as_turns: bool) -> DataFrame:
    """Of conversations inside a task the result, or their edits; of others the rows, by segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        for key, whole, rows, roles, texts in _segments(frames):
            seg += 1
            if not whole:
                done += [(key, *[None] * 7, seg, n, initial, fault, role, text) for n, ((initial, fault), role, text) in enumerate(zip(rows, roles, texts, strict=True))]
            elif as_turns:
                made = _turns(key, seg, rows, roles, texts, distances(rows, ENDS), START, True)
                done += [(key, *[None] * 5, edit, None, s, n, None, k, role, text) for _, s, n, k, edit, role, text in made]
            else:
                done.append((key, *_edited(rows, roles, texts), *[None] * 6))
            if len(done) >= 2000:
                yield _frame(done, PASSED)
                done = []
        if done:
            yield _frame(done, PASSED)

    return marked.mapInPandas(run, PASSED)


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    names, kinds = zip(*(c.split(" ") for c in ddl.split(", ")), strict=True)
    out = pd.DataFrame(rows, columns=list(names), dtype=object)
    whole = {n: {"long": "Int64", "int": "Int32"}[k] for n, k in zip(names, kinds, strict=True) if k in ("long", "int")}
    return out.astype(whole)


STATES = range(4)
SEGMENT_ROW = "key string, seg long, costs array<long>, first string, last string, illegal long, blank long, duplicate long, truncated long"
GOAL_ROW = "key string, seg long, goals array<long>, final boolean, head boolean, illegal long, blank long, duplicate long, truncated long, cost long"


def _rows_of(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[Row]]:
    frame = frame.sort_values("n")
    return frame, list(zip(frame["initial"], frame["fault"].tolist(), strict=True))


def _costs(frame: pd.DataFrame) -> pd.DataFrame:
    frame, rows = _rows_of(frame)
    to = [distances(rows, {q: 0})[0] for q in STATES]
    costs = [to[q][p] for p in STATES for q in STATES]
    return pd.DataFrame([(frame["key"].iloc[0], frame["seg"].iloc[0], costs, rows[0][0], rows[-1][0], crossed(rows), *_count([f for _, f in rows]))], columns=[c.split(" ")[0] for c in SEGMENT_ROW.split(", ")])


def _goals(frame: pd.DataFrame) -> pd.DataFrame:
    """Backwards over a conversation's segments: what lies ahead at the end of each."""
    frame = frame.sort_values("seg", ignore_index=True)
    ahead: list[int | None] = [ENDS.get(q) for q in STATES]
    goals: list[list[int | None]] = []
    for costs in reversed(frame["costs"].tolist()):
        goals.append(ahead)
        ways = [[costs[4 * p + q] + ahead[q] for q in STATES if ahead[q] is not None and costs[4 * p + q] == costs[4 * p + q] and costs[4 * p + q] is not None] for p in STATES]
        ahead = [int(min(w)) if w else None for w in ways]
    goals.reverse()
    joints = sum(a + b not in LEGAL for a, b in zip(frame["last"][:-1], frame["first"][1:], strict=True))
    n = len(frame)
    return pd.DataFrame({
        "key": frame["key"], "seg": frame["seg"], "goals": goals, "final": [i == n - 1 for i in range(n)], "head": [i == 0 for i in range(n)],
        "illegal": int(frame["illegal"].sum()) + joints, **{c: int(frame[c].sum()) for c in ("blank", "duplicate", "truncated")}, "cost": ahead[START],
    })


def _ends(goals: list) -> dict[int, int]:
    return {q: int(g) for q, g in enumerate(goals) if g is not None and g == g}


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Where a segment's walks from each state end."""
    frame, rows = _rows_of(frame)
    dist, final = distances(rows, _ends(frame["goals"].iloc[0])), bool(frame["final"].iloc[0])
    exits = [walk(rows, dist, q, final)[1] if dist[0][q] is not None else -1 for q in STATES]
    return pd.DataFrame([(frame["key"].iloc[0], frame["seg"].iloc[0], exits)], columns=["key", "seg", "exits"])


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("seg", ignore_index=True)
    q, entries = START, []
    for exits in frame["exits"]:
        entries.append(q)
        q = int(exits[q])
    return pd.DataFrame({"key": frame["key"], "seg": frame["seg"], "entry": entries})


def _walked(frame: pd.DataFrame) -> pd.DataFrame:
    frame, rows = _rows_of(frame)
    dist = distances(rows, _ends(frame["goals"].iloc[0]))
    made = _turns(frame["key"].iloc[0], int(frame["seg"].iloc[0]), rows, frame["role"].tolist(), frame["text"].tolist(), dist, int(frame["entry"].iloc[0]), bool(frame["final"].iloc[0]))
    return _frame(made, TURNS)


def _spread(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations in several segments: their edits, and the counts of each."""
    light = parts.select("key", "seg", "n", "initial", "fault")
    goals = landed(light.groupBy("key", "seg").applyInPandas(_costs, SEGMENT_ROW).groupBy("key").applyInPandas(_goals, GOAL_ROW), "goals")
    ahead = goals.select("key", "seg", "goals", "final")
    exits = light.join(ahead, ["key", "seg"]).groupBy("key", "seg").applyInPandas(_exits, "key string, seg long, exits array<int>")
    entries = exits.groupBy("key").applyInPandas(_entries, "key string, seg long, entry int")
    edits = parts.join(ahead.join(entries, ["key", "seg"]), ["key", "seg"]).groupBy("key", "seg").applyInPandas(_walked, TURNS)
    return edits, goals.where("head").select("key", "illegal", "blank", "duplicate", "truncated", "cost")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and digest of each conversation from its edits in order."""
    key, letters, digest = None, [], Digest()
    for frame in frames:
        out = []
        for k, edit, role, text in zip(frame["key"], frame["edit"], frame["role"], frame["text"], strict=True):
            if k != key:
                if key is not None:
                    out.append((key, "".join(letters), digest.sha.hexdigest()))
                key, letters, digest = k, [], Digest()
            letters.append(edit)
            if edit != "D":
                digest.add(f"{role}:{text}")
        yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, "".join(letters), digest.sha.hexdigest())], columns=["key", "audit", "repaired_sha256"])


def keyed(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), conv_id.cast("string")), F.lit("n"))


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of each conversation in order (conv_id, seg, n, k): edit, role and text as repaired (null where deleted)."""
    ship(rows.sparkSession)
    ids = rows.select(keyed(F.col(conv_id)).alias("key"), F.col(conv_id).alias("conv_id")).distinct()
    done = landed(_passed(_dealt(faulty(rows, keyed(F.col(conv_id)), F.col(turn), F.col(role), F.col(text))), True), "repaired")
    inside = done.where("audit is not null").select("key", "seg", "n", F.col("fault").alias("k"), F.col("audit").alias("edit"), "role", "text")
    edits, _ = _spread(done.where("initial is not null"))
    return inside.unionByName(edits).join(ids, "key").select("conv_id", "seg", "n", "k", "edit", "role", "text")


def repaired(rows: DataFrame, originals: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation (of ``originals``, if given): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ship(rows.sparkSession)
    marked = faulty(rows, keyed(F.col(conv_id)), F.col(turn), F.col(role), F.col(text))
    done = landed(_passed(_dealt(marked), False), "repaired")
    edits, counts = _spread(done.where("cost is null"))
    spread = counts.join(edits.repartition("key").sortWithinPartitions("key", "seg", "n", "k").mapInPandas(_digests, "key string, audit string, repaired_sha256 string"), "key")
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    results = done.where("cost is not null").select(names).unionByName(spread)
    spans = rows.groupBy(keyed(F.col(conv_id)).alias("key")).agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(F.col(turn)), F.lit(0)).cast("long").alias("gaps"))
    ids = (rows if originals is None else originals).select(keyed(F.col(conv_id)).alias("key"), F.col(conv_id).alias("conv_id")).distinct()
    out = ids.join(results, "key", "left").join(spans, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the contract's faults, by a digest of id and turn: dropped, emptied, without stops, said twice, said by the user."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat_ws(":", of("conv_id"), of("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
