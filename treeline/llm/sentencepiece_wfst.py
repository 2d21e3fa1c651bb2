"""SentencePiece encoding and decoding as a weighted finite-state transducer, over the model files of a public tokenizer.

Three machines are compiled from the model file. The normaliser reads classes of characters (blank or not) and writes the meta symbol for a
blank, one before the text, and one or none for further blanks of a run, as the model says. The lexicon maps characters to pieces: a trie
whose arcs write a piece's id, and byte arcs, which write the ids of a character's bytes where the character is no piece. The acceptor weighs
neighbouring pieces. The model is of the BPE kind: its encoding is not the path of best summed scores but the result of merging
the best-scored neighbours first. Such an encoding is exactly the path in which every two neighbouring pieces would also be left
apart if they stood alone, because no merge crosses a boundary that holds. So the acceptor gives a pair weight 0 if merging leaves it apart
and infinity if not; it is expanded lazily and remembered.

The normalised input is composed with lexicon and acceptor as far as the search goes: a state is a place in the input and the last piece, its
arcs are the lexicon's from that place, weighed by the acceptor. The shortest path of the tropical semiring is found by relaxing states
in order of their weight. All finite weights are 0, so that order is free among open states, and the one last opened by the longest arc
goes first; the first path that reaches the end is a shortest one. Every place is reached over finite weights in one way only (each prefix
of a text has one encoding), so that no state is relaxed twice.

Inputs are cut where no piece can reach across (before a meta symbol that follows something else, and around line ends), and
chunks that have been seen are remembered, up to 2 x CACHE chunks for each Python worker.

Scale: a map over rows without shuffles. The model file, a few hundred kilobytes, is read by the driver and sent to the workers, each of which
compiles it once and has bounded memories. A very long text is cut as any other; one without a place to cut takes memory by its length.

Defined results: null gives null ids, an empty text none; characters without a piece become bytes; ids that don't decode to UTF-8 give
replacement characters; decoding gives back every text that holds neither the meta symbol itself nor (if the model squeezes blanks)
runs of blanks; an empty table gives an empty result; an input column with the name of an output column gives way to it.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import with_small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
CACHE = 200_000
RUNS = re.compile(" +|[^ ]+")
#: Pairs of neighbours that a worker remembers.
PAIRS = 300_000
#: An arc is END x its end + its number. These numbers stand for the start of the input and for a character that occurs in no piece.
END = 1 << 24
START, OTHER = END - 1, END - 2
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at : at + n]
        at += n


class Normaliser:
    """A machine over two classes of characters, blank (1) and other (0), with a table of arcs: state and class to next state and output.

    The output None copies the character.
    """

    START, BETWEEN, BLANKS = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        self.prefix = META if prefix else ""
        one = (self.BETWEEN, META)
        # A blank is held back while it may be the last of the text, if blanks are squeezed; START then skips blanks.
        self.arcs = {
            (self.START, 0): (self.BETWEEN, None),
            (self.START, 1): (self.START, "") if squeeze else one,
            (self.BETWEEN, 0): (self.BETWEEN, None),
            (self.BETWEEN, 1): (self.BLANKS, "") if squeeze else one,
            (self.BLANKS, 0): (self.BETWEEN, META),
            (self.BLANKS, 1): (self.BLANKS, ""),
        }
        # Without squeezing, all states that are reached write the same for a class: the machine is a map of characters.
        self.single = not squeeze

    def run(self, text: str) -> str:
        if self.single:
            return self.prefix + text.replace(" ", META) if text else ""
        state, out = self.START, []
        for part in RUNS.findall(text):
            state, written = self.arcs[state, int(part[0] == " ")]
            out.append(written if written is not None else part)
            if part[0] != " " and written == META:
                out.append(part)
        done = "".join(out)
        return self.prefix + done if done else ""


class Transducer:
    """The compiled model; encode() and decode() run it forwards and backwards."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids, self.unknown = [0] * 256, 0
        bpe = fallback = False
        self.prefix, squeeze = True, True
        out: list[bytes] = []
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                text, score, kind = f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)
                at = len(self.pieces)
                self.pieces.append(text)
                if kind == BYTE:
                    self.byte_ids[int(text[3:5], 16)] = at
                    out.append(bytes([int(text[3:5], 16)]))
                elif kind in (UNKNOWN, CONTROL):
                    self.unknown = at if kind == UNKNOWN else self.unknown
                    out.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
                else:
                    self.ids[text], self.scores[text] = at, score
                    out.append(text.replace(META, " ").encode())
            elif number == 2:
                trainer = dict(_fields(value))
                bpe, fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                self.prefix, squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
                if norm.get(2):
                    raise ValueError("a model with a character map is not supported")
        if not bpe or not fallback:
            raise ValueError("a BPE model with byte fallback is expected")
        self.normaliser = Normaliser(self.prefix, squeeze)
        self.joined = np.frombuffer(b"".join(out), np.uint8)
        self.lengths = np.array([len(x) for x in out], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # A character that occurs in pieces but is none itself can merge, too, and gets a number beyond the pieces.
        self.symbols = self.pieces + sorted(set("".join(self.ids)) - self.ids.keys())
        # The lexicon as a trie: 2 x number + 1 if longer pieces go on from here; 1 if only those do. Number 0 is the unknown piece.
        longer = {p[:k] for p in self.ids for k in range(1, len(p))}
        numbers = self.ids | {c: i for i, c in enumerate(self.symbols) if i >= len(self.pieces)}
        self.step = {p: 2 * numbers.get(p, 0) + (p in longer) for p in longer | numbers.keys()}
        self.inner = any(re.search(f"[^{META}]{META}", p) for p in self.ids)
        self.lines = any("\n" in p for p in self.ids)
        self.cut = re.compile(rf"\n|{META}+[^{META}\n]*|[^{META}\n]+")
        self.after: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after merging the best-scored neighbours, the leftmost of equals, for as long as a piece results."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = max(((self.scores[p], -i) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def holds(self, a: int, b: int) -> bool:
        """The acceptor's weight for two neighbours is 0 rather than infinity; with a = START, for b alone."""
        if self.known > PAIRS:
            self.after.clear()
            self.known = 0
        left, right = self.symbols[a] if a != START else "", self.symbols[b]
        known = self.merged(list(left + right)) == ([left, right] if left else [right])
        self.after.setdefault(a, {})[b] = known
        self.known += 1
        return known

    def arcs(self, text: str, at: int) -> list[int]:
        """The lexicon's arcs from a place, the longest last; a character without a piece of its own has a byte arc."""
        out, step, end, n = [], self.step, at + 1, len(text)
        while end <= n:
            code = step.get(text[at:end])
            if code is None:
                break
            if code > 1:
                out.append(END * end + (code >> 1))
            if not code & 1:
                break
            end += 1
        if not out or out[0] >= END * (at + 2):
            out.insert(0, END * (at + 1) + OTHER)
        return out

    def written(self, piece: int, read: str) -> list[int]:
        """What an arc writes: its piece's id, or the ids of the bytes that it has read."""
        return [piece] if piece < len(self.pieces) else [self.byte_ids[b] for b in read.encode("utf-8", "surrogatepass")]

    def shortest(self, text: str) -> list[int]:
        """The arcs of the shortest path of the composed machine, found by relaxing its states, the last opened first."""
        n, at, last = len(text), 0, START
        taken: list[int] = []
        open_ = [self.arcs(text, 0)]
        after = self.after
        while at < n:
            arcs = open_[-1]
            row = after.get(last)
            while arcs:
                arc = arcs.pop()
                piece = arc % END
                weighs_nothing = None if row is None else row.get(piece)
                if weighs_nothing is None:
                    weighs_nothing = piece == OTHER or last == OTHER or self.holds(last, piece)
                if weighs_nothing:
                    taken.append(arc)
                    at, last = arc // END, piece
                    if at < n:
                        open_.append(self.arcs(text, at))
                    break
            else:
                open_.pop()
                taken.pop()
                at, last = divmod(taken[-1], END) if taken else (0, START)
        return taken

    def chunk(self, text: str) -> bytes:
        out, start, size = array("i"), 0, len(self.pieces)
        for arc in self.shortest(text):
            end, piece = divmod(arc, END)
            if piece < size:
                out.append(piece)
            else:
                out.extend(self.written(piece, text[start:end]))
            start = end
        return out.tobytes()

    def remembered(self, chunk: str) -> bytes:
        """A chunk's ids from the older half of the memory, or else found anew."""
        got = self.older.get(chunk)
        if got is None:
            got = self.chunk(chunk)
        if len(chunk) < 64:
            if len(self.memory) >= CACHE:
                self.older, self.memory = self.memory, {}
            self.memory[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        text = self.normaliser.run(text)
        if not text:
            return np.zeros(0, np.int32)
        if self.inner or self.lines:
            return np.frombuffer(self.chunk(text), np.int32)
        out = []
        for c in self.cut.findall(text):
            got = self.memory.get(c)
            out.append(self.remembered(c) if got is None else got)
        return np.frombuffer(b"".join(out), np.int32)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids stand for: each id's stretch of the pieces' joined bytes, gathered in one go."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        out = self.joined[np.arange(total) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return compiled(f.read())


@lru_cache(maxsize=1)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def encode_documents(docs: DataFrame, *, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """All rows and columns, with ids, n_tokens and round_trip (decoding the ids gives the text back)."""
    added = ("ids", "n_tokens", "round_trip")
    kept = [c for c in docs.columns if c.lower() not in added]
    at = kept.index(text_col)
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(sent.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                ids, ok = [], []
                for text in b.column(at):
                    text = text.as_py()
                    ids.append(None if text is None else t.encode(text))
                    ok.append(None if text is None else t.decoded(ids[-1]) == text.encode("utf-8", "surrogatepass"))
                sizes = [None if x is None else len(x) for x in ids]
                offsets = np.cumsum([0, *(n or 0 for n in sizes)], dtype=np.int32)
                flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]), pa.int32())
                mask = pa.array([n is None for n in sizes], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=mask)
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sizes, pa.int32()), pa.array(ok, pa.bool_())], names=[*kept, *added])

    rows = with_small_batches(docs).select(*[F.col(f"`{c}`") for c in kept])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, ids array<int>, n_tokens int, round_trip boolean")
