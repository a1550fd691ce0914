"""Byte-level BPE by dynamic programming over prefixes.

Under a merge-consistent vocabulary the encoding of a byte string has one possible last token for each
of its prefixes: the token that ends there and may follow the last token of the prefix before it. The
encoder stores just that token for each prefix. So it can append exactly (older entries never change)
and re-encode near an edit from the edit on, and the ids are read by walking back from the end.

A text is cut by the tokenizer's pattern first, and each piece is encoded alone. Pieces repeat, so each
Python worker keeps a bounded table of those it has seen.

Defined results. A null text is empty: no ids. Repeated rows give repeated results; other columns of the
input, whatever their names, take no part; an empty table gives an empty result. Decoding is exact for
every sequence of known ids; an unknown id is an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Chunks (what stands between white space) that a worker remembers before it lets the later three quarters go.
CACHE_CHUNKS = 800_000
#: Token pairs likewise.
CACHE_PAIRS = 1_500_000

#: White space that isn't one blank or line feed between other characters (as Python and as the pattern see it).
_IRREGULAR = re.compile("^\\s|\\s\\s|\\s$|[^\\S \\n]")


class PrefixEncoder:
    """The vocabulary, and the prefix recurrence for one piece of bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.line_feed = np.array([ranks[b"\n"]], "<u4").tobytes()
        # a trie: step[state << 8 | byte] is the next state, state_token its token or -1
        self.step: dict[int, int] = {}
        self.state_token = [-1]
        for token, rank in ranks.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                state = self.step.get(key, 0)
                if not state:
                    state = self.step[key] = len(self.state_token)
                    self.state_token.append(-1)
            self.state_token[state] = rank
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.content = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; (token, token) for a single byte."""
        found = self.parts.get(token)
        if found is None:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                options = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < token]
                if not options:
                    break
                _, i = min(options)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self.parts[token] = found
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's bytes together is [left, right].

        It is not if some merge joins a suffix of left with a prefix of right before the later of the two
        has been formed. The parts that meet at the seam are looked at from the last merge back to the first.
        """
        key = (left << 32) | right
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        a, b, result = left, right, True
        # from when on (in merge order) the present a and b both stand at the seam, until when
        until = len(self.ranks) + 1
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < until:
                result = False
                break
            if len(self.tokens[a]) == 1 and len(self.tokens[b]) == 1:
                break
            # undo whichever of the two was formed later; of equal rank, the left one is formed first
            if a > b and len(self.tokens[a]) > 1 or len(self.tokens[b]) == 1:
                until, a = a, self._split(a)[1]
            else:
                until, b = b + 1, self._split(b)[0]
        self.pairs[key] = result
        return result

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Completes ``last`` (last[i]: last token of data[:i], last[0] unused) up to the end of ``data``.

        Each known prefix hands on: every token that starts where it ends and may follow its last token is
        the last token of the longer prefix.
        """
        step, follows, pairs, ids, n = self.step.get, self.follows, self.pairs, self.state_token, len(data)
        known = len(last) - 1
        last.extend([-1] * (n - known))
        for start in range(max(0, known + 1 - self.longest), n):
            before, state, end = last[start], 0, start
            for byte in data[start:]:
                state = step(state << 8 | byte)
                if state is None:
                    break
                end += 1
                if last[end] < 0 and (token := ids[state]) >= 0:
                    if start:
                        ok = pairs.get(before << 32 | token)
                        if ok is None:
                            ok = follows(before, token)
                        if not ok:
                            continue
                    last[end] = token
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole, from its prefixes' last tokens."""
        at, out = len(last) - 1, []
        while at > 0:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        return [token] if token is not None else self.walk(self.extend(data, [0]))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def _chunk(self, chunk: str) -> bytes:
        ids = array("I")
        for piece in self.pattern.findall(chunk):
            ids.extend(self.piece(piece.encode()))
        return ids.tobytes()

    def _all(self, pieces: list[str], known: dict[str, bytes], before: str) -> list[bytes]:
        """The ids of each piece with ``before`` set before it, from the table ``known`` or anew."""
        out = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            if len(known) > CACHE_CHUNKS:  # the frequent ones came first
                head = list(islice(known.items(), CACHE_CHUNKS // 4))
                known.clear()
                known.update(head)
            for i in missing:
                ids = known.get(pieces[i])
                if ids is None:
                    ids = known[pieces[i]] = self._chunk(before + pieces[i])
                out[i] = ids
        return out

    def encode_bytes(self, text: str) -> bytes:
        # No match of the pattern holds a character and then white space. So a text with one blank or line
        # feed at a time can be cut before each of them; what is cut off is encoded alone and remembered.
        if _IRREGULAR.search(text):
            return self._chunk(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            pieces = line.split(" ")
            if i:
                out.append(self.line_feed)
            out += self._all(pieces[:1], self.chunks, "")
            out += self._all(pieces[1:], self.spaced, " ")
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an unknown id is an error."""
        if len(ids) and (int(ids.max()) >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("unknown token id")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.content[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()


class EditableEncoding:
    """A text's bytes under edit, one piece: appends and edits reuse every prefix that stands."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, encoder.extend(data, [0])

    def append(self, more: bytes) -> EditableEncoding:
        self.data += more
        self.encoder.extend(self.data, self.last)
        return self

    def replace(self, start: int, end: int, new: bytes) -> EditableEncoding:
        """Puts ``new`` in place of data[start:end]; prefixes up to ``start`` stay as they are."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        self.encoder.extend(self.data, self.last)
        return self

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


@functools.lru_cache(maxsize=4)
def load_encoder(path: str, pattern: str) -> PrefixEncoder:
    """The encoder for a file of ranks (base64 token, rank), once in each Python process."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return PrefixEncoder(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the ids of each whole text, little-endian unsigned 32-bit."""
    schema = docs.select(docs[id_col].alias("doc_id")).schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode_bytes(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, content binary): the bytes of each document's ids; null ids are none."""
    schema = encoded.select(encoded[id_col].alias("doc_id")).schema.add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            out = [encoder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""
    schema = docs.select(docs[id_col].alias("doc_id")).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, back = [], [], []
                for text in part.column(1).to_pylist():
                    raw = encoder.encode_bytes(text) if text else b""
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(np.frombuffer(raw, "<u4"))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], schema.fieldNames())

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
