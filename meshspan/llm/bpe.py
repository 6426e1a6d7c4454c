"""Byte-level BPE through a tokenization automaton.

Compilation applies the merges in order, each as one gadget on the automaton
whose arcs are tokens and whose paths are exactly the encodings so far.  Merge
k of ``a`` and ``b`` into ``c`` adds state ``c``: it is entered where ``a``
could be entered before ``b``, it is left as ``b`` is left, and the arc from
``a`` to ``b`` goes.  Arcs are not listed; a state keeps which one it was
copied from and when, so that ``arc`` answers by following copies.

A word's bytes then run through a deterministic byte automaton.  Its state is
the longest suffix that a token may continue, with the last token of the
encoding at each position of that suffix; this decides every later step, so
each (state, byte) is worked out once and is one table entry after that.  The
last tokens along the run, read backwards, are the encoding.  Decoding writes
the bytes on the arcs of the ids.

Nulls count as empty texts (no ids) and empty id lists as empty texts; ids
that the vocabulary lacks write nothing; repeated rows give equal rows; an
empty table gives none; only the named columns are read, so others may have
any name.  All words of a pack of texts take their steps together, in time
linear in the bytes and memory linear in the pack (a quarter of a megabyte, or
one longer text).  The table of a worker starts afresh between packs once it
is full, which changes no result.  There are no ties: a byte string has one
encoding.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = -1
MAX_STATES = 60_000  # of a worker's table before it starts afresh
PACK = 1 << 18  # characters that take their steps together
PUNCTUATION, LETTER, NUMBER, SPACE, EDGE = range(5)

#: Letters and numbers that Unicode 16.0 added, as first and last code points; the split of this format follows that version.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: White space, and endings that are words of their own after an apostrophe.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point, and ``EDGE`` for the one past the last."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], PUNCTUATION) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, runs in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for lo, hi in runs:
            out[lo : hi + 1] = kind
    out[list(map(ord, WHITE))] = SPACE
    return np.append(out, np.uint8(EDGE))


def word_starts(cp: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; edges (0x110000) stand alone.

    A word is a run of one class with the space before it, an ending after an
    apostrophe, or a run of white space without the last character before a word.
    """
    kind = classes()[cp]
    before, after = np.append(np.uint8(EDGE), kind[:-1]), np.append(kind[1:], np.uint8(EDGE))
    start = (kind != before) | (kind == EDGE)
    tail = (kind == SPACE) & (after < SPACE)
    start |= tail
    start[1:] &= ~(tail & (cp == 32))[:-1]
    quotes = np.flatnonzero(start & (cp == 39))
    padded = np.append(cp, np.full(2, 0x110000, cp.dtype))
    for ending in ENDINGS:
        at = quotes
        for i, c in enumerate(ending):
            at = at[padded[at + 1 + i] == ord(c)]
        start[at + 1] = False
        at = at + 1 + len(ending)
        start[at[at < len(cp)]] = True
    return start


class Automaton:
    """Tokens as bytes with their ids, and merges in order as pairs of ids with the id they make."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.length = {t: len(x) for t, x in labels.items()}
        self.lengths = np.zeros(max(labels) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.birth: dict[int, int] = {t: -1 for t, x in labels.items() if len(x) == 1}
        self.cut: dict[tuple[int, int], int] = {}
        #: states that some path enters
        self.entered = dict.fromkeys(self.birth, True)
        for k, (a, b, c) in enumerate(merges):
            self._gadget(k, a, b, c)
        self._trie()
        self._fresh()

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        if c in self.birth or a not in self.birth or b not in self.birth:
            raise ValueError(f"merge {k} makes a token twice, or of tokens that are not made yet")
        self.entered[c] = self.entered[a] and self.arc(a, b, k)
        self.left[c], self.right[c], self.birth[c] = a, b, k
        self.cut[a, b] = k

    def arc(self, t: int, u: int, before: int | None = None) -> bool:
        """Whether token ``u`` may follow ``t`` after the gadgets of the merges ``before`` (None: all)."""
        left, right, birth, cut = self.left, self.right, self.birth, self.cut
        if not self.entered[u]:
            return False
        if t == START:
            return True
        k = len(birth) if before is None else before
        while True:
            if cut.get((t, u), k) < k:
                return False
            bt, bu = birth[t], birth[u]
            if bt < 0 and bu < 0:
                return True
            if t == u:
                t, u, k = right[t], left[u], bt
            elif bt > bu:
                t, k = right[t], bt
            else:
                if left[u] == right[u] == t:  # a run of one token pairs up from the left
                    return False
                u, k = left[u], bu

    def _trie(self) -> None:
        """Trie of the tokens with suffix links: ``ends`` has the tokens that end at a node, longest first."""
        go: dict[int, int] = {}
        depth, token, inner, order = [0], [None], [False], []
        for t, label in self.labels.items():
            if not self.entered.get(t):
                continue
            n = 0
            for x in label:
                inner[n] = True
                m = go.get(n << 8 | x)
                if m is None:
                    m = go[n << 8 | x] = len(depth)
                    depth.append(depth[n] + 1)
                    token.append(None)
                    inner.append(False)
                    order.append((depth[m], n, x, m))
                n = m
            token[n] = t
        fail = [0] * len(depth)
        ends: list[tuple] = [()] * len(depth)
        for _, n, x, m in sorted(order):
            f = fail[n]
            while n and f and (f << 8 | x) not in go:
                f = fail[f]
            fail[m] = go.get(f << 8 | x, 0) if n else 0
            ends[m] = (() if token[m] is None else (token[m],)) + ends[fail[m]]
        self.go, self.depth, self.inner, self.fail, self.ends = go, depth, inner, fail, ends

    def _fresh(self) -> None:
        first = (0, (START,))
        self.states, self.ids, self.width = [first], {first: 0}, 0
        self.column = np.full(256, -1, np.int16)
        #: by state: the next state by column of a byte (-1: not worked out yet), and the last token
        self.table = np.full((1024, 64), -1, np.int32)
        self.last = np.full(1024, START, np.int32)

    def _room(self) -> None:
        """One more state or column fits."""
        rows, columns = self.table.shape
        if len(self.states) == rows or self.width == columns:
            more = np.full((rows * (1 + (len(self.states) == rows)), columns * (1 + (self.width == columns))), -1, np.int32)
            more[:rows, :columns] = self.table
            self.table = more
            self.last = np.append(self.last, np.full(len(more) - rows, START, np.int32))

    def _step(self, state: int, x: int) -> int:
        """The state after byte ``x``; enters it in the table."""
        node, lasts = self.states[state]
        go, fail = self.go, self.fail
        n = node
        while n and (n << 8 | x) not in go:
            n = fail[n]
        n = go.get(n << 8 | x, 0)
        for t in self.ends[n]:
            if self.arc(lasts[len(lasts) - self.length[t]], t):
                break
        else:
            raise ValueError(f"byte {x} has no token")
        while not self.inner[n] and n:
            n = fail[n]
        new = n, (*lasts, t)[-self.depth[n] - 1 :]
        at = self.ids.get(new)
        if at is None:
            self._room()
            at = self.ids[new] = len(self.states)
            self.states.append(new)
            self.last[at] = t
        self.table[state, self.column[x]] = at
        return at

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each byte of ``raw`` the token that ends there, or -1; words are raw[starts[i]:ends[i]] and in order."""
        if len(self.states) > MAX_STATES:
            self._fresh()
        for x in np.unique(raw):
            if self.column[x] < 0:
                self._room()
                self.column[x] = self.width
                self.width += 1
        run = np.zeros(len(raw), np.int32)
        order = np.argsort(starts - ends, kind="stable")
        at, sizes = starts[order], np.sort(ends - starts)
        state = np.zeros(len(at), np.int32)
        done = 0
        while (left := len(at) - int(np.searchsorted(sizes, done, "right"))) > 0:
            here, now = at[:left] + done, state[:left]
            x = raw[here]
            after = self.table[now, self.column[x]]
            new = np.flatnonzero(after < 0)
            if len(new):
                for key in np.unique(now[new].astype(np.int64) << 8 | x[new]).tolist():
                    self._step(key >> 8, key & 255)
                after[new] = self.table[now[new], self.column[x[new]]]
            state[:left] = run[here] = after
            done += 1
        tokens = np.full(len(raw), -1, np.int32)
        at = ends
        while len(at):
            t = self.last[run[at - 1]]
            tokens[at - 1] = t
            at = at - self.lengths[t]
            going = at > starts
            at, starts = at[going], starts[going]
        return tokens


def labels_of(d: dict) -> tuple[dict[int, bytes], dict[str, int]]:
    """Of a vocabulary file: the bytes of each token by id, and the ids of the added tokens."""
    letters = byte_letters()
    labels = {i: bytes(map(letters.__getitem__, t)) for t, i in d["model"]["vocab"].items()}
    return labels, {x["content"]: x["id"] for x in d.get("added_tokens", [])}


class Arcs:
    """What the arcs of ids write; all that decoding needs."""

    def __init__(self, spec: str):
        labels, added = labels_of(json.loads(spec))
        labels |= {i: t.encode("utf-8") for t, i in added.items()}
        #: by id, and nothing at the end for ids without a label
        self.labels = np.full(max(labels) + 2, b"", object)
        self.labels[list(labels)] = list(labels.values())

    def decode(self, ids: np.ndarray) -> str:
        known = np.where((ids >= 0) & (ids < len(self.labels)), ids, -1)
        return b"".join(self.labels[known].tolist()).decode("utf-8", "replace")


class Codec:
    """A vocabulary file of the byte-level kind: the automaton, and added tokens that are cut out of a text first."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, pre = d["model"], d.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or d.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        if any(x.get(k) for x in d.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or need word ends are not read")
        labels, self.added = labels_of(d)
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.cutter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` one after the other, and where each text's end."""
        pieces, marks, after = [], [], []
        for text in texts:
            cut = self.cutter.split(text) if self.cutter else [text]
            pieces += cut[::2]
            marks += [self.added[x] for x in cut[1::2]] + [-1]
            after.append(len(pieces))
        joined = "\n".join(pieces) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        edges = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        cp[edges] = 0x110000
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        size[edges] = 1
        at = np.cumsum(size) - size
        first = np.flatnonzero(word_starts(cp))
        starts, ends = at[first], np.append(at[first[1:]], len(raw))
        words = cp[first] != 0x110000
        tokens = self.automaton.encode(raw, starts[words], ends[words])
        tokens[at[edges]] = marks
        stops = np.cumsum(tokens >= 0)[at[edges[np.array(after) - 1]]]
        return tokens[tokens >= 0], stops


@functools.lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """Compiled once in each worker that encodes."""
    return Codec(spec)


@functools.lru_cache(maxsize=2)
def arcs(spec: str) -> Arcs:
    return Arcs(spec)


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file as text, read by the driver: a file of a few megabytes, which goes to the tasks with their code."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` to (``id_col``, ids array<int>): one row a row, in any order.

    With ``decoded``, a column of that name has the ids decoded again by the same
    worker, so that a round trip needs no second one beside it.
    """
    spec = vocabulary(path)
    key = docs.schema[id_col].dataType

    def run(batches):
        c, back = codec(spec), arcs(spec) if decoded else None
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= PACK or i + 1 == batch.num_rows:
                    ids, stops = c.encode(texts)
                    out = {id_col: batch.column(0).slice(first, len(texts)), "ids": pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(ids, pa.int32()))}
                    if back:
                        out["decoded"] = pa.array([back.decode(x) for x in np.split(ids, stops)[:-1]], pa.string())
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                    first, texts, size = i + 1, [], 0

    schema = f"`{id_col}` {key.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, ``ids_col``) back to (``id_col``, text)."""
    spec = vocabulary(path)
    key = encoded.schema[id_col].dataType

    def run(batches):
        c = arcs(spec)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            texts = pa.array((c.decode(ids[a:b]) for a, b in zip([0, *ends], ends)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {key.simpleString()}, text string")
