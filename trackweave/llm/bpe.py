"""BPE encoding and decoding by a tokenization automaton.

States stand for "the last token was t".  Merges are added in rank order by
the merge gadget: for a merge (u, v) -> w, the state after u loses its arc v
(that pair would have been merged), every state with an arc u gains an arc w,
and the state after w starts as a copy of the state after v.  Token sequences
that the automaton accepts are exactly the BPE encodings, and a text, as each
of its prefixes, has one such path.  Arcs are kept as exceptions: each state
lists the arcs that its gadgets removed with their rank, an arc w lives where
the arc u lived, and a copied state keeps the removals older than the copy.

Over bytes that automaton is not deterministic: an arc spells several of them.
The subset construction makes it so.  A state of the result is the set of arcs
under way, each as the state it left and the bytes of its label so far; one of
them at most ends at any byte, which is the last token of the prefix up to
there.  So a pre-token is encoded byte by byte, one look into the transition
table each, never back, and the tokens are read off the last tokens from the
end on.  Rows of the table are compiled when first needed: all of them would
be many more than texts ever use.  Decoding emits the arc labels.

Rows: null text counts as empty.  Repeated rows stay, a null doc_id is
carried through, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import only, small_batches, worker_cache

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges of a byte-level BPE.

    vocab: label bytes -> id; merges: pairs of label bytes in rank order.
    table_limit: transitions kept; a full table is compiled afresh.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], table_limit: int = 1_000_000):
        size = max(vocab.values(), default=-1) + 1
        self.vocab, self.limit = vocab, table_limit
        self.label: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.label[i] = b
        self.rank = [-1] * size  # gadget number that made a token; -1 for letters
        self.left, self.right = [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}  # (u, v) -> rank of the gadget that took arc v from the state after u
        self.size = size
        made = {i for b, i in vocab.items() if len(b) == 1}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in made and v in made and w not in made and self._lives(u, v):
                self.cut[u * size + v] = rank
                self.left[w], self.right[w], self.rank[w] = u, v, rank
                made.add(w)
        self.spelt: dict[int, int] = {}  # (node, byte) -> node of the labels' bytes
        self.ends = [-1]  # node -> the token that it spells
        for b, i in vocab.items():
            if i in made:
                node = 0
                for c in b:
                    if (key := node << 8 | c) not in self.spelt:
                        self.spelt[key] = len(self.ends)
                        self.ends.append(-1)
                    node = self.spelt[key]
                self.ends[node] = i
        self._clear()

    def _clear(self) -> None:
        begin = ((-1, 0),)
        self.table: dict[int, int] = {}  # (state, byte) -> state
        self.states, self.named = [begin], {begin: 0}
        self.last = [-1]  # state -> the last token of the prefix that leads there

    def _compile(self, state: int, byte: int) -> int:
        """The entry (state, byte) of the table."""
        under_way, last = [], -1
        for origin, node in self.states[state]:
            if (node := self.spelt.get(node << 8 | byte)) is not None:
                under_way.append((origin, node))
                token = self.ends[node]
                if token >= 0 and (origin < 0 or self._lives(origin, token)):
                    last = token
        if last < 0:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        new = (*under_way, (last, 0))
        if (to := self.named.get(new)) is None:
            to = self.named[new] = len(self.states)
            self.states.append(new)
            self.last.append(last)
        self.table[state << 8 | byte] = to
        return to

    def _lives(self, t: int, w: int) -> bool:
        """Whether the state after t has the arc w, from the gadgets so far.

        x runs through the ends of t with the time at which each was itself
        merged away, y through the beginnings of w; the arc is gone if a
        gadget took y from x while both stood next to each other.  Of equal
        pairs in a row the left one is merged first.
        """
        rank, left, right, cut, size = self.rank, self.left, self.right, self.cut, self.size
        x, x_till = t, 1 << 60
        while x >= 0:
            y, y_till = w, 1 << 60
            while y >= 0:
                r = cut.get(x * size + y)
                if r is not None and r < x_till and r <= y_till:
                    return False
                y, y_till = left[y], rank[y]
            x, x_till = right[x], rank[x]
        return True

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(self.table) > self.limit:
            self._clear()
        table, last, label, state, at = self.table.get, self.last, self.label, 0, []
        for byte in word:
            to = table(state << 8 | byte)
            state = self._compile(state, byte) if to is None else to
            at.append(last[state])
        path, end = [], len(word)
        while end:
            path.append(at[end - 1])
            end -= len(label[path[-1]])
        return path[::-1]


class Codec:
    """Whole texts to ids and back, by the automaton of a byte-level BPE file."""

    def __init__(self, path: str, memo: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not tokens.splits_alone(spec):
            raise ValueError("the automaton takes byte-level BPE files without normalizer")
        letters = byte_letters()
        raw = lambda s: bytes(map(letters.__getitem__, s))
        added = tokens.added_tokens(spec)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs])
        self.cut, self.most = tokens.cutter(added), memo
        self.own = {"\0\0" + k: v.to_bytes(4, "little") for k, v in added.items()}
        self.words = dict(self.own)
        self.encode = tokens.ChunkMemo(added, self._plain, self._plain).encode
        self.labels = dict(enumerate(self.automaton.label)) | {v: k.encode() for k, v in added.items()}

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids text by text; pre-tokens that came before are not walked again."""
        if len(self.words) > self.most:
            self.words = dict(self.own)
        words, walk, out = self.words, self.automaton.encode, []
        for text in texts:
            ids = []
            for w in self.cut(text):
                if (x := words.get(w)) is None:
                    x = array("I", walk(w.encode("utf-8"))).tobytes()
                    if len(w) <= tokens.LONGEST:
                        words[w] = x
                ids.append(x)
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """Arc labels in order; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    kept = worker_cache("bpe")
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def encode(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    path = tokenizer or tokens.default_path()
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for first, part in tokens.in_parts(texts):
                out = [np.frombuffer(b, "<i4") for b in codec(path).encode(part)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(part)), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = tokenizer or tokens.default_path()

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them (see RESULT)."""
    path = tokenizer or tokens.default_path()
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for first, part in tokens.in_parts(texts):
                c = codec(path)
                enc = c.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(part)),
                        pa.array([len(b) // 4 for b in enc], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in enc]),
                        pa.array([hashlib.sha256(c.decode(b).encode("utf-8")).hexdigest() for b in enc]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, RESULT)
