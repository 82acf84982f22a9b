"""Token ids by the tokenizers library, at corpus speed.

A byte-level BPE file cuts a text at its added tokens and then into
pre-tokens, and encodes every pre-token on its own.  So each different piece
needs to be encoded once: ``ChunkMemo`` keeps the ids of those that it has
met.  Files of another kind go to the library text by text.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import regex

from .common import worker_cache

# The fixed pre-token pattern of byte-level BPE files with use_regex.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def splits_alone(spec: dict) -> bool:
    """True if pre-tokens can be encoded one by one."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    return (
        plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    )


def cutter(added: dict[str, int]):
    """A function that cuts a text into pre-tokens; an added token follows two NUL characters."""
    find = regex.compile(PRE_TOKEN).findall
    names = sorted(added, key=len, reverse=True)
    parts = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def cut(text: str) -> list[str]:
        if parts is None or not any(a in text for a in names):
            return find(text)
        return [w for i, part in enumerate(parts(text)) for w in (["\0\0" + part] if i % 2 else find(part))]

    return cut


# Marks that make one pre-token when they end a chunk of letters.
TAIL = ".,;:!?)]}$&%*#"


LONGEST = 64  # characters of a chunk that is worth keeping; so the memo is bounded in bytes too


class _Memo(dict):
    """Looking up what is not there gives None and is noted in ``new``."""

    def __init__(self):
        self.new: dict[str, None] = {}

    def __missing__(self, chunk: str) -> None:
        self.new[chunk] = None


class ChunkMemo:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, each chunk encoded once.

    A text is cut before its spaces and line feeds.  A chunk has the same
    pre-tokens wherever it stands, as long as no run of white space reaches
    over its edges; so a text with a chunk that is empty or has white space at
    an edge goes the long way, as a whole.  A chunk of letters with marks at
    its end is two pre-tokens, looked up on their own.  encode and
    encode_chunks give the ids of a list of strings.  The memo is bounded:
    when full it takes nothing new, and starts afresh if most of a batch is
    strange to it.
    """

    def __init__(self, added: dict[str, int], encode, encode_chunks, most: int = 1_000_000):
        self.added, self.plain, self.short, self.most = added, encode, encode_chunks, most
        self.chunks, self.tails = _Memo(), {}

    def _learn(self, new) -> dict[str, bytes]:
        """Ids of chunks that are not in the memo; without those that have none of their own."""
        whole, ended, have = {}, [], self.chunks.get
        for c in new:
            body = c[1:] if c[:1] == "\n" else c
            if not body or body[0].isspace() or body[-1].isspace():
                continue
            base = body.rstrip(TAIL)
            if len(base) < len(body) and base.isalpha():
                key = c[: len(c) - len(body) + len(base)]
                ended.append((c, key, body[len(base) :]))
                if have(key) is None:
                    whole[key] = None
            else:
                whole[c] = None
        found = dict(zip(whole, self.short([c if c[0] == "\n" else " " + c for c in whole])))
        if ended:
            tails = list({t for _, _, t in ended} - self.tails.keys())
            if len(self.tails) > 100_000:
                self.tails, tails = {}, list({t for _, _, t in ended})
            self.tails.update(zip(tails, self.plain(tails)))
            for c, key, t in ended:
                found[c] = (have(key) or found[key]) + self.tails[t]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.chunks
        memo.new = {}
        look = memo.__getitem__
        split = [[""] if any(a in t for a in self.added) else t.replace("\n", " \n").split(" ") for t in texts]
        heads = [s[0] for s in split]
        parts = [[b"", *map(look, s[1:])] for s in split]
        found = self._learn(memo.new)
        out: list[bytes | None] = []
        for s, part, first, head in zip(split, parts, heads, self.plain(heads)):
            fits = bool(first) and not first[-1].isspace()
            part[0] = head
            for i in [i for i, x in enumerate(part) if x is None]:
                if (x := found.get(s[i])) is None:
                    fits = False
                    break
                part[i] = x
            out.append(b"".join(part) if fits else None)
        long_way = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(long_way, self.plain([texts[i] for i in long_way])):
            out[i] = x
        if len(memo) < self.most:
            memo.update((c, x) for c, x in found.items() if len(c) <= LONGEST)
        elif 3 * len(memo.new) > sum(map(len, split)):
            memo.clear()
        return out


class LibraryEncoder:
    """encode(texts) by the tokenizers library."""

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.encode = ChunkMemo(added_tokens(spec), self._whole, self._chunks, memo).encode if splits_alone(spec) else self._whole

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks by one call: as the lines of one text, cut at the line feed's id.

        A line feed between two chunks is a pre-token of its own, and chunks
        hold none but at their front.
        """
        feed = self._whole(["\n"])[0]
        if len(feed) != 4 or len(chunks) < 64:
            return self._whole(chunks)
        lines = [c if c[0] == "\n" else "\n" + c for c in chunks]
        step = 2000  # the library slows down on longer texts
        ids = b"".join(self._whole(["".join(lines[i : i + step]) for i in range(0, len(lines), step)]))
        at = np.flatnonzero(np.frombuffer(ids, "<u4") == int.from_bytes(feed, "little")) * 4
        if len(at) != len(chunks):
            return self._whole(chunks)
        ends = [*at[1:].tolist(), len(ids)]
        return [ids[a if c[0] == "\n" else a + 4 : b] for c, a, b in zip(chunks, at.tolist(), ends)]


def in_parts(texts: list[str], size: int = 2_000_000):
    """Runs of texts of about size characters, each with its first index."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > size:
            yield first, texts[first:i]
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, texts[first:]


def encoder(path: str, memo: int = 1_000_000) -> LibraryEncoder:
    """One encoder for each file, size of memo and Python worker."""
    kept = worker_cache("tokens")
    if (path, memo) not in kept:
        kept[path, memo] = LibraryEncoder(path, memo)
    return kept[path, memo]
