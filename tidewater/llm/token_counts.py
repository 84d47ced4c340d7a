"""Token counts from a compiled finite-state transducer, without building tokens.

A byte-level BPE's encoding of a word is the only split into tokens in which every two neighbours would be encoded
to themselves.  So the last token of every prefix is decided by the last few bytes and by the last tokens of the
prefixes before: a finite state.  ``Transducer`` compiles states and transitions as they are first needed and notes
on each transition by how much the count of tokens changes; reading a word is then one lookup a byte.

Texts of more than ``split_chars`` characters are cut into chunks that many tasks count.  A cut falls at a single space between two other
characters, where a token always starts, or else within a run of letters, numbers or other signs, where it does not.  Such a chunk
maps the state before it to the state after it and a count, for the states that the text before the cut passes through; from any
other state the transducer runs on until it meets the known run, as it does within a few bytes of ordinary text.  A document's maps, not
its texts, then meet and are composed in order of their chunks.  Where a state neither is known nor meets the run (no text is known to do so) the
document is counted whole.  A long text without any such place, as one of short words on lines of their own or of blanks alone, is counted by one task.

Defined results: null or empty text: no bytes, no tokens; special strings inside texts count as one token, as the
library does by default; repeated rows give repeated results; an empty table gives an empty result; extra columns are
left out.
"""

from __future__ import annotations

import json
import pickle
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_bytes, cut, id_text, pieces, placed_rows

BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of pre-token byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        self.vocab = {as_bytes(t) for t in spec["model"]["vocab"] if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.starts = {t[:i] for t in self.vocab for i in range(len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self.state((b"", (b"",), (0,)))

    def state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.ids[key]

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens next to each other are the encoding of their bytes; an empty ``a``: b alone."""
        got = self.fits.get((a, b))
        if got is None:
            parts = [bytes([x]) for x in a + b]
            while len(parts) > 1:
                rank, i = min((self.merges.get((x, y), 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = self.fits[a, b] = parts == ([a, b] if a else [b])
        return got

    def compile(self, s: int, byte: int) -> tuple[int, int]:
        """The transition of state ``s`` on ``byte``: (next state, change of the count).

        A state is (suffix, last, behind): the longest suffix that may yet grow into a token, the last token of the
        prefix that ends at each offset back into it, and by how much that prefix's count differs from the count now.
        """
        suffix, last, behind = self.states[s]
        suffix += bytes([byte])
        for n in range(len(suffix), 0, -1):
            token = suffix[-n:]
            if token in self.vocab and self.stays(last[n - 1], token):
                break
        else:
            raise ValueError("no token ends here; the vocabulary lacks a byte")
        change = behind[n - 1] + 1
        last, behind = (token, *last), (0, *(b - change for b in behind))
        keep = next(n for n in range(len(suffix), -1, -1) if suffix[len(suffix) - n :] in self.starts)
        self.moves[s][byte] = move = (self.state((suffix[len(suffix) - keep :], last[: keep + 1], behind[: keep + 1])), change)
        return move

    def run(self, s: int, data: bytes) -> tuple[int, int]:
        """The state after ``data`` and the change of the count."""
        n, moves = 0, self.moves
        for byte in data:
            move = moves[s].get(byte) or self.compile(s, byte)
            s = move[0]
            n += move[1]
        return s, n

    def count(self, data: bytes) -> int:
        return self.run(self.start, data)[1]

    def trace(self, s: int, data: bytes) -> tuple[list[int], list[int]]:
        """States and counts after 0, 1, ... bytes."""
        states, counts = [s], [0]
        for byte in data:
            move = self.moves[s].get(byte) or self.compile(s, byte)
            s = move[0]
            states.append(s)
            counts.append(counts[-1] + move[1])
        return states, counts

    def meet(self, s: int, data: bytes, states: list[int], counts: list[int]) -> tuple[int, int] | None:
        """As run, from another state: (state, change) once it meets the trace of ``data``, which gives the rest; None if it never does."""
        n = 0
        for i, byte in enumerate(data):
            if s == states[i]:
                return states[-1], n + counts[-1] - counts[i]
            move = self.moves[s].get(byte) or self.compile(s, byte)
            s = move[0]
            n += move[1]
        return (s, n) if s == states[len(data)] else None


class Irregular(Exception):
    """The text has other blanks than single ones between words."""


class WordCounts(dict):
    """Word -> count, with ``lead`` in front of it; filled as words are met, emptied when large."""

    def __init__(self, counter: Counter, lead: str, most: int = 300_000):
        self.counter, self.lead, self.most = counter, lead, most

    def __missing__(self, word: str) -> int:
        if word.split() != [word]:
            raise Irregular
        if len(self) >= self.most:
            self.clear()
        self[word] = got = self.counter.segments(self.lead + word)
        return got


class Counter:
    """Counts the tokens of text: cuts it into pre-tokens and runs the transducer."""

    def __init__(self, path: str):
        self.machine = Transducer(path)
        self.kinds: dict[str, str] = dict.fromkeys(BLANKS, "s")
        self.first, self.next = WordCounts(self, ""), WordCounts(self, " ")
        self.special_bytes = {x.encode() for x in self.machine.special}

    def kind(self, c: str) -> str:
        """s blank, L letter, N number, O other."""
        if c not in self.kinds:
            top = unicodedata.category(c)[0]
            self.kinds[c] = top if top in "LN" else "O"
        return self.kinds[c]

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends at a token's edge."""
        if not text:
            return 0
        try:
            n, first, following = -1, self.first, self.next.__getitem__
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                n += 1 + first[head] + sum(map(following, rest))
            return n
        except Irregular:
            return self.segments(text)

    def segments(self, text: str) -> int:
        """As count, whatever blanks there are: cut at special strings, then into pre-tokens."""
        return sum(1 if p in self.special_bytes else self.machine.count(p) for p in self.parts(text))

    def parts(self, text: str):
        """Pre-tokens and special strings, in order."""
        while text:
            at, special = min(((text.find(s), s) for s in self.machine.special if s in text), default=(len(text), ""), key=lambda x: (x[0], -len(x[1])))
            for p in self.pretokens(text[:at]):
                yield p.encode()
            if special:
                yield special.encode()
            text = text[at + len(special) :]

    def pretokens(self, text: str):
        i, n, kind = 0, len(text), self.kind
        while i < n:
            if text[i] == "'":
                found = next((c for c in CONTRACTIONS if text.startswith(c, i)), None)
                if found:
                    yield found
                    i += len(found)
                    continue
            j = i + (text[i] == " " and i + 1 < n)
            k = kind(text[j])
            end = j + 1
            if k != "s":
                while end < n and kind(text[end]) == k:
                    end += 1
            else:
                end = i + 1
                while end < n and kind(text[end]) == "s":
                    end += 1
                if end < n and end - i > 1:
                    end -= 1
            yield text[i:end]
            i = end


STATES = 400_000  # how many compiled states a process keeps for its next texts; ten thousand varied documents make 160,000


@lru_cache(maxsize=1)
def kept_counter(path: str) -> Counter:
    return Counter(path)


def counter_of(path: str) -> Counter:
    """One counter a process, since workers run many tasks and compiling takes as long as counting; a fresh one where it has grown large."""
    counter = kept_counter(path)
    if len(counter.machine.states) > STATES:
        kept_counter.cache_clear()
        counter = kept_counter(path)
    return counter


WINDOW = 4096  # how far a cut looks for a space, and how many bytes of a head are kept
CONTEXT = 64


def chunks_of(text: str, size: int, counter: Counter) -> list[tuple[str, str, bool]]:
    """The text in chunks of about ``size`` characters: (chunk, context, whether the last pre-token goes on in the next chunk).

    The context is the end of the run that the cut before the chunk interrupts; it is empty where a token starts.
    """
    kind, specials = counter.kind, counter.machine.special

    def inside(i: int) -> bool:
        """Whether the characters on both sides of ``i`` are surely in one pre-token."""
        k = kind(text[i - 1])
        if k == "s" or kind(text[i]) != k or k == "L" and (i < 3 or kind(text[i - 2]) != "L" or kind(text[i - 3]) != "L"):
            return False  # up to two letters may belong to a contraction
        return not any(text.find(x, max(0, i - len(x) - 2), i + len(x)) >= 0 for x in specials)

    edges: list[tuple[int, bool]] = [(0, False)]
    at = size
    while at < len(text) - 1:
        spaces = range(at, min(at + WINDOW, len(text) - 1))
        found = next((i for i in spaces if text[i] == " " and kind(text[i - 1]) != "s" and kind(text[i + 1]) != "s"), None)
        joined = found is None
        if joined:
            found = next((i for i in range(at, len(text)) if inside(i)), None)
        if found is None:
            break
        edges.append((found, joined))
        at = found + size
    out = []
    for (a, joined), (b, goes_on) in zip(edges, [*edges[1:], (len(text), False)]):
        start = a
        while joined and start > max(0, a - CONTEXT) and kind(text[start - 1]) == kind(text[a]):
            start -= 1
        out.append((text[a:b], text[start:a], goes_on))
    return out


def chunk_map(chunk: str, context: str, goes_on: bool, counter: Counter) -> dict:
    """The state map of a chunk.

    ``head``: the first bytes of what belongs to the pre-token before, ``head_size`` its length; ``entries``: for states before the chunk, the
    state and count after the head; ``n``: tokens after the head; ``exit``: the state at the end, None where the head is all there is.
    """
    machine, kind = counter.machine, counter.kind
    end, special = 0, min((at for x in machine.special if (at := chunk.find(x)) >= 0), default=len(chunk))
    while context and end < special and kind(chunk[end]) == kind(context[-1]):
        end += 1
    head, rest = chunk[:end].encode(), chunk[end:]
    entries = {}
    if head:
        before, _ = machine.trace(machine.start, context.encode())
        states, counts = machine.trace(before[-1], head)
        for s in dict.fromkeys([before[-1], *before]):
            after, n = machine.meet(s, head, states, counts) or machine.run(s, head)
            entries[machine.states[s]] = (machine.states[after], n)
    out = {"head": head[:WINDOW], "head_size": len(head), "entries": entries, "n": 0, "exit": None}
    if not goes_on:
        return out | {"n": between(rest, counter), "exit": machine.states[machine.start]}
    if not rest:
        return out
    at = next((i for i in range(len(rest) - 2, 0, -1) if rest[i] == " " and kind(rest[i - 1]) != "s" and kind(rest[i + 1]) != "s"), 0)
    *closed, last = counter.parts(rest[at:])
    state, n = machine.run(machine.start, last)
    closed_tokens = sum(1 if p in counter.special_bytes else machine.count(p) for p in closed)
    return out | {"n": between(rest[:at], counter) + closed_tokens + n, "exit": machine.states[state]}


def between(inner: str, counter: Counter) -> int:
    """Tokens of text that starts and ends at a token's edge."""
    return counter.count("." + inner) - counter.count(".") if inner.startswith(" ") and inner[1:2] not in ("", " ") else counter.count(inner)


def composed(maps: list[dict], counter: Counter) -> int | None:
    """The count of a document from the maps of its chunks, in order; None if a state is not known and does not meet the known run."""
    machine, total = counter.machine, 0
    state = machine.states[machine.start]
    for m in maps:
        if m["head_size"]:
            got = m["entries"].get(state)
            if got is None:
                (first, (after, n)), head = next(iter(m["entries"].items())), m["head"]
                states, counts = machine.trace(machine.state(first), head)
                met = machine.meet(machine.state(state), head, states, counts)
                if met is not None:
                    got = (after, met[1] + n - counts[-1])
                elif len(head) == m["head_size"]:
                    s, k = machine.run(machine.state(state), head)
                    got = (machine.states[s], k)
                else:
                    return None
            state = got[0]
            total += got[1]
        total += m["n"]
        state = m["exit"] or state
    return total


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, chunk_chars: int = 1 << 16, split_chars: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.  ``tokenizer``: a byte-level BPE file that every executor can read."""
    rows = id_text(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        for batch in pieces(batches):
            counter = counter_of(tokenizer)
            texts = as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in texts], pa.int64()), pa.array([counter.count(b.decode()) for b in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def chunks(batches):
        counter = counter_of(tokenizer)
        for batch in pieces(batches):
            for i, (row, text) in enumerate(zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")))):
                for part, (chunk, context, goes_on) in enumerate(chunks_of(text.decode(), chunk_chars, counter)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), batch.column("doc_id").slice(i, 1), pa.array([part], pa.int64()), pa.array([chunk], pa.string()), pa.array([context], pa.string()), pa.array([goes_on])],
                        ["row", "doc_id", "part", "text", "context", "goes_on"],
                    )

    def maps(batches):
        counter = counter_of(tokenizer)
        for batch in pieces(batches):
            chunk = [b.decode() for b in as_bytes(batch.column("text"))]
            made = [pickle.dumps(chunk_map(*x, counter)) for x in zip(chunk, batch.column("context").to_pylist(), batch.column("goes_on").to_pylist())]
            m = pa.StructArray.from_arrays([batch.column("part"), pa.array(made, pa.binary())], ["part", "map"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([len(x.encode()) for x in chunk], pa.int64()), m], ["row", "doc_id", "n_bytes", "m"])

    def closed(batches):
        counter = counter_of(tokenizer)
        for batch in batches:
            n = [composed([pickle.loads(x["map"]) for x in ms], counter) for ms in batch.column("ms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["row", "doc_id", "n_bytes", "n_tokens"])

    out = f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    short = rows.filter(F.length("text") <= split_chars).mapInArrow(whole, out)
    long = cut(placed_rows(df, id_col, text_col).filter(F.length("text") > split_chars))
    parts = long.mapInArrow(chunks, f"row bigint, doc_id {kind}, part bigint, text string, context string, goes_on boolean").repartition("row", "part")
    mapped = parts.mapInArrow(maps, f"row bigint, doc_id {kind}, n_bytes bigint, m struct<part:bigint,map:binary>")
    joined = mapped.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list("m")).alias("ms")).select("row", "doc_id", "n_bytes", "ms")
    counted = cut(joined.mapInArrow(closed, f"row bigint, {out}"))
    again = long.join(counted.filter("n_tokens is null").select("row"), "row", "left_semi").select("doc_id", "text").mapInArrow(whole, out)
    done = counted.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    return short.union(done).union(again).withColumn("over_limit", F.col("n_tokens") > limit)
