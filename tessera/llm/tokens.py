"""Fast exact encoding with the ``tokenizers`` library.

``Tokenizer.encode_batch`` spends most of its time re-deriving the pieces of
words it has seen many times before.  :class:`ChunkEncoder` cuts a text at
places where the tokenizer's own pre-tokenizer always cuts, remembers the ids
of each chunk, and lets the library encode the chunks it has not met yet.  The
ids equal those of ``encode`` on the whole text; a tokenizer whose rules are
not known to allow such cuts, and any on a text that holds one of its added
tokens literally, is simply run on whole texts.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import repeat

import numpy as np

from . import shared

_SPACE_BEFORE_WORD = re.compile(r" (?=\S)")
_LATIN, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[!-&(-/:-@\\[-`{-~]*"
_LATIN_THEN_MARKS = re.compile(f"({_LATIN})({_MARKS})(?:(\n{_LATIN})({_MARKS}))?\x1f|[^\x1f]*\x1f")
_INFO_SEPARATORS = re.compile("[\x1c-\x1f]")

#: The split pattern of the word-end vocabulary.
_WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def resolve(path_or_name: str) -> str:
    """A tokenizer file: a path as it is, a bare name among the public files."""
    if "/" in path_or_name:
        return path_or_name
    import public_tokenizers

    return public_tokenizers.path(path_or_name)


class ChunkEncoder:
    """Encodes texts to id arrays; remembers about ``limit`` chunks."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        path = resolve(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"].get("vocab") or {}
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]  # taken out of a text before it is cut: such texts are encoded whole
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before memo was last begun anew
        self.heads: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.mode = "whole"
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if any(t["normalized"] for t in added):
            pass
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.mode = "byte"
            self.widths = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self.widths[i] = len(token)
        elif norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            parts = pre.get("pretokenizers", [])
            if [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == _WORD_END_PATTERN:
                self.mode = "word"
                self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
                self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _joined(self, chunks: list[str]) -> None:
        """Encodes chunks of any form, many in one call, and remembers their ids."""
        for at in range(0, len(chunks), 2000):
            some = chunks[at : at + 2000]
            if self.mode == "byte":
                ids = self._ids(" " + " ".join(some))
                ends = np.cumsum([len(c.encode()) + 1 for c in some])
                cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
            else:
                got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids = np.asarray(got.ids, dtype=self.dtype)
                starts = np.fromiter((a for a, _ in got.offsets), dtype=np.int64, count=len(ids))
                cuts = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in some]), side="left")
            self._keep(self.memo, some, ids, cuts)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _keep(self, memo: dict[str, bytes], keys: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        raw, last = ids.tobytes(), 0
        for key, cut in zip(keys, (cuts * self.dtype.itemsize).tolist()):
            memo[key] = raw[last:cut]
            last = cut

    def _learn(self, chunks: list[str]) -> None:
        """Remembers new chunks. Latin letters with a tail of punctuation are
        two pieces to either pre-tokenizer, and a single line break within such
        a chunk is a piece of its own, so each word is encoded once."""
        if self.older:
            known = list(map(self.older.get, chunks))
            self.memo.update((c, x) for c, x in zip(chunks, known) if x is not None)
            chunks = [c for c, x in zip(chunks, known) if x is None]
        joined = "\x1f".join(chunks) + "\x1f"
        if joined.count("\x1f") != len(chunks):
            return self._joined(chunks)
        found = _LATIN_THEN_MARKS.findall(joined.lower() if self.mode == "word" else joined)
        stems, tails = self.stems, self.tails
        if len(stems) > self.limit:
            stems.clear()
        self._stems({t[0] for t in found if t[0] not in stems}, " ")
        self._stems({t[2] for t in found if t[2] not in stems}, "")
        if len(tails) > self.limit:
            tails.clear()
        for marks in {m for t in found for m in (t[1], t[3]) if m not in tails}:
            tails[marks] = self._whole(marks)
        stems[""] = b""
        self.memo.update(zip(chunks, [(stems[a] + tails[b] + stems[c] + tails[d] if c else stems[a] + tails[b]) if a else None for a, b, c, d in found]))
        if rest := [c for c, t in zip(chunks, found) if not t[0]]:
            self._joined(rest)

    def _stems(self, new: set[str], before: str) -> None:
        """Encodes words, each with a space or a line break before it."""
        new.discard("")
        words = list(new)
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = self._ids(before + before.join(some))
            if self.mode == "byte":
                ends = np.cumsum([len(c.encode()) + len(before) for c in some])
                cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
            else:
                cuts = np.flatnonzero(self.ends_word[ids]) + 1
            self._keep(self.stems, some, ids, cuts)

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of :attr:`dtype`."""
        if self.mode == "whole":
            return [self._whole(t) for t in texts]
        collects = gc.isenabled()
        gc.disable()  # millions of small lists without cycles
        try:
            return self._encode_raw(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_raw(self, texts: list[str]) -> list[bytes]:
        heads, parts, found, gaps, odd, new = [b""] * len(texts), [], [], [], {}, set()
        if len(self.memo) > self.limit:
            self.older, self.memo = self.memo, {}
        get, loose = self.memo.get, self.loose
        for i, t in enumerate(texts):
            if any(x in t for x in self.added) or self.mode == "word" and _INFO_SEPARATORS.search(t):
                odd[i] = self._whole(t)
                p = []
            elif self.mode == "word":
                p = t.split()
            else:
                p = t.split(" ")
                heads[i] = self._head(p.pop(0))
            ids, gap = self._look(p, get)
            if gap and self.mode == "byte" and any(loose(p[k]) for k in gap):
                p = _SPACE_BEFORE_WORD.split(t)
                heads[i] = self._head(p.pop(0))
                ids, gap = self._look(p, get)
            new.update([p[k] for k in gap])
            parts.append(p)
            found.append(ids)
            gaps.append(gap)
        if new:
            self._learn(list(new))
        memo, out = self.memo, []
        for i, (p, ids, gap) in enumerate(zip(parts, found, gaps)):
            for k in gap:
                ids[k] = memo[p[k]]
            out.append(odd[i] if i in odd else heads[i] + b"".join(ids))
        return out

    @staticmethod
    def loose(chunk: str) -> bool:
        """Whether the space before this chunk is followed by white space (or
        nothing), where the pre-tokenizer does not cut."""
        return not chunk or chunk[0].isspace()

    @staticmethod
    def _look(p: list[str], get) -> tuple[list, list[int]]:
        """The known ids of chunks, and the places of those not known."""
        ids, gap, at = list(map(get, p)), [], -1
        try:
            while True:
                at = ids.index(None, at + 1)
                gap.append(at)
        except ValueError:
            return ids, gap

    def _head(self, head: str) -> bytes:
        if (ids := self.heads.get(head)) is None:
            ids = self._whole(head)
            if len(head) < 100:
                if len(self.heads) > self.limit // 10:
                    self.heads.clear()
                self.heads[head] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=d) for x, d in zip(self.encode_raw(texts), repeat(self.dtype))]


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this process for a tokenizer file."""
    return shared.keep(("encoder", path), lambda: ChunkEncoder(path))


def slices(texts: list[str], chars: int = 1 << 21):
    """Index ranges of at most about ``chars`` characters, for bounded memory."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
