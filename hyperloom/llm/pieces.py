"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once. At each position it follows its output links through
every piece that ends there, longest first, and each relaxes the best score of the
position. A character that is no piece can be spelled by its UTF-8 byte pieces, at a
price below every piece. Scores of the model are whole numbers, so sums are exact;
of equal scores the longest last piece wins.

No piece of the model reaches across a blank that follows something else, and none
but a single one holds a line break (both are read off the piece table, not assumed).
The best path is therefore the concatenation of the best paths between those places.
Stretches that a worker does not remember are read side by side: one step moves the
automaton of all of them by a character and relaxes all their positions in arrays.
Longer stretches, and those with a character that is no piece, are read one by one
by the same automaton.

Blanks become U+2581 and one is put in front, as the model expects. A U+2581 that is in
the text itself is spelled by bytes, so decoding gives back every text exactly.

Null text encodes to null ids and decodes to null; empty text to no ids. Ids and
repeated rows are passed through; columns that are not named are ignored; an empty
table gives an empty result. Of two ways with one score the one whose last piece is longer
is taken, at every place, so results do not depend on batches. A very long text is read
in windows of ``WINDOW`` characters that end between stretches, so beside the text
itself and its ids a task holds no more for it than for short ones.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a U+2581 of the text; no decoded text can hold a lone surrogate.
OWN_MARK = "\ud800"
#: Stretches a worker remembers before it starts afresh: some 20 MB.
REMEMBER = 100_000
#: Longer stretches are encoded each time, and one by one.
SIDE_BY_SIDE = 64
#: Cells of the arrays in which stretches are read side by side.
CELLS = 400_000
#: Characters of one text read at once.
WINDOW = 1_000_000
ROWS_OUT = 256
#: Tokens spelled at once.
TOKENS_AT_ONCE = 1 << 18


def piece_table(path: str = MODEL) -> dict:
    """What the codec needs of a model: bounded by its vocabulary, so that it can go along with a task."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words, raw = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            words.append((piece, i, model.get_score(i)))
    digest = hashlib.sha256(repr((words, sorted(raw.items()))).encode("utf-8", "surrogatepass")).hexdigest()
    return {"words": words, "raw": raw, "size": model.get_piece_size(), "digest": digest}


class Automaton:
    """Aho-Corasick automaton in arrays.

    Characters of pieces of several characters have columns in ``move``, which gives the
    next state with all failures resolved. Any other character leads to its own child of the root
    from everywhere. Pieces are numbered from 1 as outputs; ``first`` is a state's longest
    output, ``link`` an output's next shorter one, 0 is none.
    """

    def __init__(self, words: list[tuple[str, int, float]]):
        letters = sorted({c for w, _, _ in words if len(w) > 1 for c in w})
        column = {c: n for n, c in enumerate(letters)}
        children: list[dict[str, int]] = [{}]
        ends = [0]
        for n, (w, _, _) in enumerate(words, 1):
            at = 0
            for c in w:
                kid = children[at].get(c)
                if kid is None:
                    kid = children[at][c] = len(children)
                    children.append({})
                    ends.append(0)
                at = kid
            ends[at] = n
        self.size = np.array([0] + [len(w) for w, _, _ in words], dtype=np.int32)
        self.score = np.array([0.0] + [x for _, _, x in words])
        self.id = np.array([-1] + [i for _, i, _ in words], dtype=np.int32)
        self.link = np.zeros(len(words) + 1, dtype=np.int32)
        self.first = np.zeros(len(children), dtype=np.int32)
        self.width = len(letters)
        move = np.zeros((len(children), max(1, self.width)), dtype=np.uint16 if len(children) < 2**16 else np.int32)
        fail = [0] * len(children)
        todo = [0]
        for at in todo:  # breadth first: shorter states are ready
            if at:
                move[at] = move[fail[at]]
                shorter = self.first[fail[at]]
                if ends[at]:
                    self.link[ends[at]] = shorter
                self.first[at] = ends[at] or shorter
            for c, kid in children[at].items():
                k = column.get(c)
                if k is not None:
                    fail[kid] = int(move[at, k]) if at else 0
                    move[at, k] = kid
                todo.append(kid)
        self.move = move
        #: Per code point: its column, or width + its state, or -1 if it is no piece.
        self.code = np.full(0x110000, -1, dtype=np.int32)
        for c, kid in children[0].items():
            if ends[kid]:
                self.code[ord(c)] = column.get(c, self.width + kid)
        self.loose = [ord(c) for c in letters if self.code[ord(c)] < 0]  # only inside longer pieces
        self.columns = column


class Codec:
    def __init__(self, pieces: dict):
        words = pieces["words"]
        self.automaton = Automaton(words)
        self.raw = pieces["raw"]
        self.spelled = min(s for _, _, s in words) - 10.0
        long = [p for p, _, _ in words if len(p) > 1]
        blank_inside = any(re.search(f"[^{MARK}]{MARK}", p) for p in long)
        break_inside = any("\n" in p for p in long)
        self.stretches = None if blank_inside else re.compile(" *[^ ]+| +" if break_inside else "\n| *[^ \n]+| +")
        spelling = [b""] * pieces["size"]
        for piece, i, _ in words:
            spelling[i] = piece.replace(MARK, " ").encode()
        for b, i in self.raw.items():
            spelling[i] = bytes([b])
        self.letters = np.frombuffer(b"".join(spelling), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in spelling])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seen: dict[str, bytes] = {}

    def viterbi(self, stretch: str) -> list[int]:
        """Ids of the best path through one stretch."""
        s = stretch.replace(MARK, OWN_MARK).replace(" ", MARK)
        n = len(s)
        auto = self.automaton
        move, first, link, size, own, columns = auto.move, auto.first, auto.link, auto.size, auto.score, auto.columns
        code = auto.code[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tolist()
        score, last = [0.0] * (n + 1), [0] * (n + 1)  # last: the output taken, 0 for bytes
        state = 0
        for e in range(n):
            c = code[e]
            if c >= auto.width:
                state = c - auto.width
            else:
                k = c if c >= 0 else columns.get(s[e], -1)
                state = move.item(state, k) if k >= 0 else 0
            best, how = None, 0
            out = first.item(state)
            while out:
                v = score[e + 1 - size.item(out)] + own.item(out)
                if best is None or v > best:
                    best, how = v, out
                out = link.item(out)
            if c < 0:
                v = score[e] + self.spelled * len(self.utf8(s[e]))
                if best is None or v > best:
                    best, how = v, 0
            score[e + 1], last[e + 1] = best, how
        out_ids: list[int] = []
        e = n
        while e:
            how = last[e]
            if how:
                out_ids.append(auto.id.item(how))
                e -= size.item(how)
            else:
                out_ids.extend(self.raw[b] for b in reversed(self.utf8(s[e - 1])))
                e -= 1
        out_ids.reverse()
        return out_ids

    def together(self, words: list[str]) -> None:
        """Works out stretches of up to ``SIDE_BY_SIDE`` characters, all of them pieces, side by side, and remembers them."""
        auto = self.automaton
        words.sort(key=len, reverse=True)
        at = 0
        while at < len(words):
            some = words[at : at + max(1, CELLS // len(words[at]))]
            at += len(some)
            length = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            n, deep = len(some), len(some[0])
            flat = auto.code[np.frombuffer("".join(some).replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32)]
            code = np.zeros((deep, n), dtype=np.int32)
            column = np.repeat(np.arange(n), length)
            row = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            code[row, column] = flat
            live = np.searchsorted(-length, -np.arange(deep), side="left")  # words longer than e
            score = np.zeros((deep + 1, n))
            how = np.zeros((deep, n), dtype=np.int32)
            of = score.reshape(-1)
            state = np.zeros(n, dtype=np.int64)
            every = np.arange(n)
            move, width = auto.move.reshape(-1), auto.width
            for e in range(deep):
                m = live[e]
                c = code[e, :m]
                state = state[:m]
                apart = np.flatnonzero(c >= width)
                state = move.take(state * width + np.minimum(c, width - 1)).astype(np.int64)
                if len(apart):
                    state[apart] = c[apart] - width
                out = auto.first.take(state)  # every character is a piece, so there is one
                best = of.take((e + 1 - auto.size.take(out)) * n + every[:m]) + auto.score.take(out)
                taken = out.copy()
                out = auto.link.take(out)
                rest = np.flatnonzero(out)
                out = out[rest]
                while len(rest):
                    v = of.take((e + 1 - auto.size.take(out)) * n + rest) + auto.score.take(out)
                    better = v > best.take(rest)
                    spot = rest[better]
                    best[spot], taken[spot] = v[better], out[better]
                    out = auto.link.take(out)
                    more = out > 0
                    rest, out = rest[more], out[more]
                score[e + 1, :m], how[e, :m] = best, taken
            used = np.zeros((n, deep), dtype=bool)
            end, who = length.copy(), every
            while len(who):
                used[who, end - 1] = True
                end = end - auto.size.take(how[end - 1, who])
                more = end > 0
                end, who = end[more], who[more]
            column, row = np.nonzero(used)
            ids = auto.id.take(how[row, column]).astype(np.int32).tobytes()
            ends = (np.cumsum(np.bincount(column, minlength=n)) * 4).tolist()
            self.seen.update(zip(some, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Puts what is not remembered yet into ``seen``; gives back the ids of what is never remembered."""
        seen = self.seen
        if len(seen) + len(stretches) > REMEMBER:
            seen.clear()
        fresh = list(stretches.difference(seen))
        alone = {w for w in fresh if len(w) > SIDE_BY_SIDE}
        side = [w for w in fresh if len(w) <= SIDE_BY_SIDE]
        if side:
            size = np.fromiter(map(len, side), dtype=np.int64, count=len(side))
            known = self.automaton.code[np.frombuffer("".join(side).replace(MARK, OWN_MARK).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] >= 0
            whole = np.logical_and.reduceat(known, np.cumsum(size) - size)
            for k in np.flatnonzero(~whole).tolist():
                seen[side[k]] = array("i", self.viterbi(side[k])).tobytes()
            if not whole.all():
                side = [w for w, fine in zip(side, whole.tolist(), strict=True) if fine]
            self.together(side)
        return {w: array("i", self.viterbi(w)).tobytes() for w in alone}

    @staticmethod
    def utf8(c: str) -> bytes:
        return (MARK if c == OWN_MARK else c).encode()

    def windows(self, text: str) -> Iterator[list[str]]:
        """The stretches of a text, some at a time."""
        if self.stretches is None:
            yield [text]
            return
        lo = 0
        while lo < len(text):
            hi = lo + WINDOW
            while hi < len(text):  # a stretch begins where blanks begin
                cut = text.rfind(" ", lo + 1, hi)
                while cut > lo and text[cut - 1] == " ":
                    cut -= 1
                if cut > lo:
                    hi = cut
                    break
                hi += WINDOW
            yield self.stretches.findall(text, lo, min(hi, len(text)))
            lo = hi

    def packed(self, text: str) -> bytes:
        """Ids of a text, as int32 bytes."""
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text, as int32 bytes; null stays null."""
        out: list[bytes | None] = []
        part: list[list[str] | None] = []
        held = 0

        def flush() -> None:
            rare = self.learn(set().union(*filter(None, part)))
            find = self.seen.__getitem__ if not rare else lambda w: rare[w] if w in rare else self.seen[w]
            out.extend(None if ws is None else b"".join(map(find, ws)) for ws in part)
            part.clear()

        for t in texts:
            if t and len(t) > WINDOW:
                flush()
                whole = []
                for ws in self.windows(" " + t):
                    part.append(ws)
                    flush()
                    whole.append(out.pop())
                out.append(b"".join(whole))
                continue
            part.append(None if t is None else [] if not t else self.stretches.findall(" " + t) if self.stretches else [" " + t])
            held += len(t or "")
            if held > WINDOW:
                flush()
                held = 0
        flush()
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def spelled_out(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, gathered from the piece table."""
        out = []
        for at in range(0, len(ids), TOKENS_AT_ONCE):
            some = ids[at : at + TOKENS_AT_ONCE]
            sizes = self.sizes[some]
            index = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes)
            index += np.arange(len(index))
            out.append(self.letters[index].tobytes())
        return b"".join(out)

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts whose ids lie between each two neighbours of ``bounds``."""
        raw = self.spelled_out(ids)
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), dtype=np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


_CODECS: dict[str, Codec] = {}


def codec_of(pieces: dict) -> Codec:
    """One codec per worker process and piece table."""
    key = pieces["digest"]
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(pieces)
    return _CODECS[key]


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", model: str = MODEL) -> DataFrame:
    """The columns of ``keep``, ids array<int>."""
    ship(docs.sparkSession)
    pieces = piece_table(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(pieces)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                packs = codec.packed_all(batch.column(n).to_pylist())
                ends = np.cumsum([0, *[len(x) // 4 if x else 0 for x in packs]], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(filter(None, packs)), dtype=np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in packs]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], ids], [*keep, "ids"])

    return docs.select(*[docs[c] for c in keep], docs[text].alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns of ``keep``, text."""
    ship(encoded.sparkSession)
    pieces = piece_table(model)
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(pieces)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                lists = batch.column(n)
                bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
                texts = codec.decode_all(lists.flatten().to_numpy(zero_copy_only=False), bounds)
                texts = [t if good else None for t, good in zip(texts, lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*[encoded[c] for c in keep], encoded[ids].alias("_ids")).mapInArrow(run, schema)
