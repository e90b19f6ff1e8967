"""Token counts by a transducer compiled from a byte-level BPE vocabulary.

The library's encoding of a piece is the one sequence of tokens in which each
two neighbours, alone, would stay as they are. So the last token of a prefix
depends on the prefix's last bytes only: of the tokens that end there, it is
the one that can follow the last token of what stands before it. That makes a
deterministic transducer over bytes. Its state is the longest suffix that
begins some token and, for each suffix that does, the last token before it and
how many tokens fewer the text has up to there. A transition is annotated with
the number of tokens that it adds, which may be negative when a longer token
takes the place of several. States are compiled when first met.

A text is cut into chunks of fixed size. No piece spans a place where a blank
follows a non-blank, so a chunk maps whatever is pending at its start to a
count and to what is pending at its end. These maps are associative and are
composed by a balanced scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, texts

#: The pattern that splits text into pieces; a fixed value of the vocabulary's format.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Compiled states of one vocabulary."""

    def __init__(self, path: str, most_states: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.ids: dict[str, int] = {}
        spelled = [*byte, *(a + b for a, b in merges)]
        for t in spelled:
            self.ids.setdefault(t, len(self.ids))
        self.pair = {}
        n = len(self.ids)
        self.right, self.left = [[(t, NEVER)] for t in range(n)], [[(t, NEVER)] for t in range(n)]
        usable = [True] * n
        made: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            x, y, t = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair.setdefault((x, y), rank)
            if t in made:
                continue
            made.add(t)
            usable[t] = usable[x] and usable[y] and self._apart(x, y, rank)
            # pieces at the token's edges while it grows, each with the rank of the merge that ends it
            self.right[t] += [(p, min(r, rank)) for p, r in self.right[y]]
            self.left[t] += [(p, min(r, rank)) for p, r in self.left[x]]
        self.most_states = most_states
        self._build_trie([bytes(byte[c] for c in t) for t in self.ids], usable)
        self.reset()

    def _apart(self, x: int, y: int, until: int = NEVER) -> bool:
        """Whether no merge joins a piece at x's end to one at y's begin before rank ``until``.

        Such a merge takes place if both pieces exist when its rank comes: of
        equal ranks the one further left goes first.
        """
        for p, ends in self.right[x]:
            for q, stops in self.left[y]:
                rank = self.pair.get((p, q))
                if rank is not None and rank < min(ends, until) and rank <= stops:
                    return False
        return True

    def _build_trie(self, tokens: list[bytes], usable: list[bool]) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [None]
        for t, spelled in enumerate(tokens):
            node = 0
            for b in spelled:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(None)
                node = self.child[node][b]
            if usable[t]:
                self.token[node] = t
        self.fail = [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            below = []
            for node in level:
                for b, c in self.child[node].items():
                    f = self.fail[node]
                    while f and b not in self.child[f]:
                        f = self.fail[f]
                    self.fail[c] = self.child[f].get(b, 0)
                    below.append(c)
            level = below

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.go: list[dict[int, tuple[int, int]]] = []
        self.apart: dict[tuple[int, int], bool] = {}
        self._state((0, ((0, None, 0),)))

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.go.append({})
        return self.states[key]

    def _compile(self, state: int, b: int) -> tuple[int, int]:
        """The state after one more byte, and the tokens that it adds."""
        node, held = self.keys[state]
        before = {d: (last, less) for d, last, less in held}
        f = node
        while f and b not in self.child[f]:
            f = self.fail[f]
        node = self.child[f][b]
        chain = []
        f = node
        while f:
            chain.append(f)
            f = self.fail[f]
        for f in chain:
            t = self.token[f]
            if t is not None:
                last, less = before[self.depth[f] - 1]
                if last is None or self._may_follow(last, t):
                    added = less + 1
                    break
        else:
            raise ValueError("no token ends here")
        now = tuple((self.depth[f], before[self.depth[f] - 1][0], before[self.depth[f] - 1][1] - added) for f in chain) + ((0, t, 0),)
        got = self._state((node, now)), added
        self.go[state][b] = got
        return got

    def _may_follow(self, last: int, t: int) -> bool:
        if (last, t) not in self.apart:
            self.apart[last, t] = self._apart(last, t)
        return self.apart[last, t]

    def run(self, piece: bytes) -> int:
        """The number of tokens of one piece."""
        if len(self.keys) > self.most_states:
            self.reset()
        state, count, go = 0, 0, self.go
        for b in piece:
            state, added = go[state].get(b) or self._compile(state, b)
            count += added
        return count


class _Known(dict):
    """Counts of pieces met before."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        n = self.transducer.run(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str, chunk: int = 1 << 16, keep: int = 300_000):
        self.transducer = Transducer(path)
        self.known, self.chunk, self.keep = _Known(self.transducer), chunk, keep
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.transducer.special, key=len, reverse=True))) or r"(?!)")

    def plain(self, text: str) -> int:
        """Tokens of a text whose begin and end are piece boundaries."""
        return sum(map(self.known.__getitem__, PIECE.findall(text))) if text else 0

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(what joins the pending text, tokens between, what is pending then); the last is None if no boundary lies inside."""
        first = CUT.search(chunk)
        if not first:
            return chunk, 0, None
        last = first.start()
        for at in range(len(chunk) - 1, last, -1):
            if chunk[at].isspace() and CUT.match(chunk, at):
                last = at
                break
        return chunk[: first.start()], self.plain(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First a, then b."""
        if a[2] is None:
            head = a[0] + b[0]
            # a boundary may lie just where the two meet
            if a[0] and b[0] and CUT.match(head, len(a[0])):
                return a[0], (self.plain(b[0]) if b[2] is not None else 0) + b[1], b[0] if b[2] is None else b[2]
            return head, b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2]

    def __call__(self, text: str) -> int:
        if len(self.known) > self.keep:
            self.known.clear()
        total = 0
        at = 0
        for m in self.special.finditer(text):
            total += self._segment(text[at : m.start()]) + 1
            at = m.end()
        return total + self._segment(text[at:])

    def _segment(self, text: str) -> int:
        if len(text) <= self.chunk:
            return self.plain(text)
        maps = [self.chunk_map(text[a : a + self.chunk]) for a in range(0, len(text), self.chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.plain(head) + count + self.plain(tail or "")


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One counter for each vocabulary and worker; what it has compiled serves later tasks."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    path: a vocabulary file that every executor can open. Null and empty texts
    have no bytes and no tokens. Rows that repeat are counted each; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            raw = texts(b.column(1))
            n = [count(t.decode("utf-8", "replace")) for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
