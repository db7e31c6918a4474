"""BPE encoding and decoding by a deterministic automaton compiled from the merge list.

Merge gadgets. The automaton starts with one state that loops on every base symbol. The merge rules
are applied in rank order. The gadget of a rule ``u v -> w`` cuts the arc ``v`` from the state that
reading ``u`` leads to, and gives every state that had the arc ``u`` (followed by ``v``) an arc ``w`` to
the state that ``v`` leads to at that time. After the last rule the sequences of arcs from the first state
are exactly the token sequences that BPE can produce: there is one state for each token read last, and an
arc is missing just where an earlier rule would have joined across the seam. A rule whose arcs were all
cut before it makes no token. States copy their arcs from the state of their right part, arcs come with the
arc of their left part, so the automaton is kept as one cut for each rule; an arc is there if no cut of
the state's chain of right parts, made before the copy, hits the arc's chain of left parts.

Determinisation. Arcs are spelled out symbol by symbol, and the machine on symbols is made deterministic:
one of its states is the set of arcs being read, each with the state that it left. Transitions are
entered in the table (state, symbol) -> state when they are first needed, up to MOST_STATES states, after
which the table starts anew. Exactly one arc can end at a place, so a state also tells the last token of
what was read. Encoding a pre-split word is one table step for each symbol and one for its last symbol
(which carries the end-of-word suffix); the tokens are then read off from the end. Nothing is searched or
tried again. Decoding emits the arc labels.

Pre-splitting follows the tokenizer file (NFC, white space to blanks, lower case, the split pattern,
byte symbols, an end-of-word suffix); special tokens in the raw text are arcs of their own.

A null text is an empty text; an empty text has no tokens, and its decoded text is empty. Texts of
any length are encoded whole. Repeated rows give repeated results; an empty table gives no rows. Columns
beyond the id and the text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, sliced, utf8_column

#: What a worker remembers: chunks between blanks, pre-split words; states of the determinised automaton (about 700 bytes each).
CACHE_CHUNKS = 400_000
MOST_STATES = 200_000
NEVER = 1 << 60
#: White space as the file's pattern has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(f"[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable symbol of every byte: itself where printable in Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Remembered(dict):
    """What ``make`` gives for a chunk, remembered until there are too many."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str):
        out = self.make(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        self[chunk] = out
        return out


class MergeAutomaton:
    """The automaton of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.labels = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: t for t, i in self.special.items()}
        self._compile(model["merges"])
        self._spell_out()
        self.pieces: dict[str, bytes] = {}
        self.to_symbols = dict(enumerate(byte_symbols()))
        splits = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.split = regex.compile(splits[0].replace("\\s", SPACE))
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ids_of = Remembered(lambda c: array("I", self._chunk(c)).tobytes())

    def _compile(self, merges: list) -> None:
        """Applies the gadgets of all rules in rank order."""
        size = max(self.labels, default=-1) + 1
        #: token -> its parts and the rule that made it; base symbols have no parts
        self.left, self.right, self.born = [-1] * size, [-1] * size, [NEVER] * size
        #: token u -> arc v -> the rule that cut v from the state after u
        self.cuts: dict[int, dict[int, int]] = {}
        made = {a + b for a, b in (r.split(" ") if isinstance(r, str) else r for r in merges)}
        self.arcs = {i for t, i in self.ids.items() if t not in made}
        for n, rule in enumerate(merges):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            u, v, w = self.ids[a], self.ids[b], self.ids[a + b]
            if w in self.arcs:
                raise ValueError(f"two rules make {a + b!r}")
            if u in self.arcs and v in self.arcs and self.has_arc(u, v):
                self.left[w], self.right[w], self.born[w] = u, v, n
                self.arcs.add(w)
                self.cuts.setdefault(u, {})[v] = n

    def has_arc(self, t: int, w: int) -> bool:
        """Does the state after token t have the arc w, after all gadgets so far?"""
        u, copied = t, NEVER
        while u >= 0:
            cuts = self.cuts.get(u)
            if cuts is not None:
                x, born = w, NEVER
                while x >= 0:
                    n = cuts.get(x)
                    # the rule that made an arc of two equal tokens also cuts the second from the first
                    if n is not None and n < copied and n <= born:
                        return False
                    born, x = self.born[x], self.left[x]
            copied, u = self.born[u], self.right[u]
        return True

    def _spell_out(self) -> None:
        """The labels of all arcs as a tree of symbols: node -> symbol -> node; arcs inside a word and arcs that end it."""
        end = len(self.suffix)
        self.tree: list[dict[int, int]] = [{}]
        self.inner: dict[int, int] = {}
        self.final: dict[int, int] = {}
        self.length: dict[int, int] = {}
        self.whole: dict[str, int] = {}
        for label, w in self.ids.items():
            if w not in self.arcs:
                continue
            ends = label.endswith(self.suffix)
            text = label[: len(label) - end] if ends else label
            node = 0
            for c in text:
                below = self.tree[node].get(ord(c))
                if below is None:
                    below = self.tree[node][ord(c)] = len(self.tree)
                    self.tree.append({})
                node = below
            self.length[w] = len(text)
            if ends:
                self.final[node] = self.whole[text] = w
            if not ends or not end:
                self.inner[node] = w
        self._restart()

    def _restart(self) -> None:
        """Only the first state of the determinised automaton: all arcs of the first state are about to be read."""
        self.members: list[tuple[int, ...]] = [(0, -1)]  # node, token before, node, token before ...
        self.last = [-1]
        self.numbers = {self.members[0]: 0}
        self.moves: dict[int, int] = {}
        self.ends: dict[int, int] = {}

    def _move(self, state: int, c: int) -> int:
        """Enters the transition of a state on symbol c."""
        out: list[int] = []
        last = -1
        reading = self.members[state]
        for node, t in zip(reading[::2], reading[1::2], strict=True):
            below = self.tree[node].get(c)
            if below is None:
                continue
            w = self.inner.get(below)
            if w is not None and last < 0 and (t < 0 or self.has_arc(t, w)):
                last = w
            if self.tree[below]:
                out += (below, t)
        if last < 0:
            raise ValueError(f"no token for symbol {chr(c)!r}")
        key = (*out, 0, last)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.members)
            self.members.append(key)
            self.last.append(last)
        self.moves[state << 9 | c] = number
        return number

    def _end(self, state: int, c: int) -> int:
        """Enters the token that a word ends with if its last symbol is c."""
        reading = self.members[state]
        for node, t in zip(reading[::2], reading[1::2], strict=True):
            w = self.final.get(self.tree[node].get(c, -1))
            if w is not None and (t < 0 or self.has_arc(t, w)):
                self.ends[state << 9 | c] = w
                return w
        raise ValueError(f"no token for last symbol {chr(c)!r}")

    def word(self, text: str) -> list[int]:
        """Token ids of one pre-split word, by table steps."""
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(self.to_symbols)
        if not text:
            return []
        if len(self.members) > MOST_STATES:
            self._restart()
        moves, last, length = self.moves, self.last, self.length
        state, path = 0, [0]
        symbols = list(map(ord, text))
        final = symbols.pop()
        for c in symbols:
            step = moves.get(state << 9 | c)
            state = self._move(state, c) if step is None else step
            path.append(state)
        w = self.ends.get(state << 9 | final)
        if w is None:
            w = self._end(state, final)
        out, at = [w], len(text) - length[w]
        while at:
            w = last[path[at]]
            out.append(w)
            at -= length[w]
        return out[::-1]

    def _chunk(self, chunk: str) -> list[int]:
        """Token ids of what stands between two blanks."""
        if chunk.isalpha():
            return self.word(chunk)
        # most chunks are a word and a sign
        cut = [chunk[:-1], chunk[-1]] if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha() else self.split.findall(chunk)
        out: list[int] = []
        for m in cut:
            ids = self.ids_of[m] if m.isalpha() else self.pieces.get(m)
            if ids is None:
                if len(self.pieces) >= CACHE_CHUNKS:
                    self.pieces.clear()
                ids = self.pieces[m] = array("I", self.word(m)).tobytes()
            out += array("I", ids)
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids: list[bytes] = []
        for piece, special in self._pieces(text):
            if special:
                ids.append(np.array([self.special[piece]], dtype="<u4").tobytes())
                continue
            piece = unicodedata.normalize("NFC", piece)
            # lower case by single characters: no rule for the last letter of a word
            piece = piece.replace("Σ", "σ").lower()
            chunks = [c for c in _SPACES.split(piece) if c] if _ODD_SPACE.search(piece) else piece.split()
            ids += map(self.ids_of.__getitem__, chunks)
        out = b"".join(ids)
        return out, self.decode(out)

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.at_special is None or "<|" not in text and not self.at_special.search(text):
            yield text, False
            return
        at = 0
        for m in self.at_special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def decode(self, ids: bytes) -> str:
        """The arc labels of encoded ids, joined as the file's (absent) decoder does."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    """One per worker process. ``path`` must be readable on every executor (the tokenizer files are installed there)."""
    with open(path, encoding="utf-8") as f:
        out = MergeAutomaton(json.load(f))
    gc.freeze()  # its many small tables need not be looked through again
    return out


def release() -> None:
    """Gives back the memory of a worker's automata; their tables hold each other, so frozen ones would stay."""
    if automaton.cache_info().currsize:
        automaton.cache_clear()
        gc.unfreeze()
        gc.collect()


KEPT.append(release)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<long>) and decoded: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in sliced(batches):
            cols: dict[str, list] = {n: [] for n in names}
            for t in utf8_column(batch, "text"):
                ids, words = auto.encode("" if t is None else t.decode("utf-8", "replace"))
                cols["n_tokens"].append(len(ids) // 4)
                cols["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(words.encode()).hexdigest())
                if with_ids:
                    cols["ids"].append(np.frombuffer(ids, dtype="<u4").astype(np.int64))
                    cols["decoded"].append(words)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **cols}, schema=schema)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int64()), "decoded": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *((n, kinds[n]) for n in names)])
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
