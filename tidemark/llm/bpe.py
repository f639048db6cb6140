"""BPE encoding and decoding by a traversal that shares prefixes.

The last token of the encoding of a prefix, with the encoding of what stands before that token, is the whole
encoding of the prefix. So each node of a trie of words needs one number, its last token, and that follows from the
numbers of its ancestors: of the vocabulary's tokens that end there, it is the one that may stand after the
last token of the node where it begins. A pair of tokens may stand together if merging its bytes gives the pair again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: The split of byte-level tokenizers of this family (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that the lengths of possible last tokens are looked up by.
TAIL = 4


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixEncoder:
    """Encodes words of one vocabulary; words of one call share the work on their common prefixes."""

    def __init__(self, path: str, keep: int = 500_000):
        spec = json.loads(Path(path).read_text("utf-8"))
        to_byte = printable_bytes()
        spell = lambda s: bytes(to_byte[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {spell(t): i for t, i in vocabulary.items()}
        self.spelled = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[spell(a)], self.ids[spell(b)]): (k, self.ids[spell(a + b)]) for k, (a, b) in enumerate(merges)}
        # lengths of the tokens that end on these TAIL bytes; those of shorter tokens are added when a tail is first seen
        self.long: dict[bytes, list[int]] = {}
        for n, tail in sorted({(-len(b), b[-TAIL:]) for b in self.ids if len(b) >= TAIL}):
            self.long.setdefault(tail, []).append(-n)
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.written = {str(i): b for i, b in self.spelled.items()}
        self.keep, self.known = keep, dict[str, str]()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank and then leftmost first; only for single tokens and pairs."""
        parts = [self.ids[word[k : k + 1]] for k in range(len(word))]
        while len(parts) > 1:
            best = min(((self.ranks[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.ranks), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.ranks[parts[k], parts[k + 1]][1]]
        return parts

    def tail_lengths(self, tail: bytes) -> tuple[int, ...]:
        """Lengths of all tokens that can end where a text ends on `tail`, longest first."""
        if len(self.lengths) > 500_000:
            self.lengths.clear()
        found = self.lengths[tail] = (*self.long.get(tail, ()), *(n for n in range(min(TAIL - 1, len(tail)), 0, -1) if tail[len(tail) - n :] in self.ids))
        return found

    def fits(self, before: int, token: int) -> bool:
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        known = self.pairs[before, token] = self.merge(self.spelled[before] + self.spelled[token]) == [before, token]
        return known

    def alone(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.spelled[token]) == [token]
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words in byte order are the depth-first walk of their trie; `last` is the path from its root."""
        ids, lengths, spelled, pairs = self.ids, self.lengths, self.spelled, self.pairs
        last: list[int] = [-1]
        previous = b""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                tail = word[end - TAIL if end > TAIL else 0 : end]
                for length in lengths.get(tail) or self.tail_lengths(tail):
                    begin = end - length
                    if begin < 0 or (token := ids.get(word[begin:end])) is None:
                        continue
                    if begin:
                        fits = pairs.get((last[begin], token))
                        if fits is None:
                            fits = self.fits(last[begin], token)
                    else:
                        fits = self.alone(token)
                    if fits:
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            previous, out, end = word, [], n
            while end:
                out.append(last[end])
                end -= len(spelled[last[end]])
            yield word, out[::-1]

    def learn(self, words: Iterable[str]) -> None:
        """Puts the ids of each word, as text, into `known`."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = set(words)
        by_bytes = {w.encode(): w for w in new}
        for spelled, out in self.encode_words(by_bytes):
            self.known[by_bytes[spelled]] = ",".join(map(str, out))

    def decode(self, out: Iterable[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, out))

    def decode_listed(self, listed: str) -> bytes:
        """The text of decimal ids, in UTF-8; bytes that are none become U+FFFD."""
        data = b"".join(map(self.written.__getitem__, listed.split(","))) if listed else b""
        return data.decode("utf-8", "replace").encode()

    def pieces(self, text: str) -> list[str]:
        """Words of a text, and special tokens that are spelled out in it, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.split.findall(part))]

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        words = dict(self.encode_words({w.encode() for w in pieces if w not in self.special}))
        return [t for w in pieces for t in ([self.special[w]] if w in self.special else words[w.encode()])]


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text, and the text that they decode to.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (array<int>). One scan, no shuffle.
    Null texts count as empty: no token, digests of the empty string. Null and repeated ids are kept as they are.
    A special token that is spelled out in a text is that token, as the tokenizer's own library has it.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            column = texts(batch.column(1))
            out: tuple[list, list, list, list] = ([], [], [], [])
            begin = 0
            while begin < len(column):  # words are learned for about a million characters at a time
                end, room = begin, 1_000_000
                while end < len(column) and (end == begin or room > 0):
                    room -= len(column[end])
                    end += 1
                split = [e.pieces(t) for t in column[begin:end]]
                e.learn(set().union(*split) - e.special.keys())
                known = e.known
                for text, words in zip(column[begin:end], split):
                    special = e.special.keys() & set(words) if e.cut is not None and any(x in text for x in e.special) else ()
                    listed = ",".join([known[w] if w not in special else str(e.special[w]) for w in words] if special else map(known.__getitem__, words))
                    out[0].append(listed.count(",") + 1 if listed else 0)
                    out[1].append(hashlib.sha256(listed.encode()).hexdigest())
                    out[2].append(hashlib.sha256(e.decode_listed(listed)).hexdigest())
                    if with_ids:
                        out[3].append([int(x) for x in listed.split(",")] if listed else [])
                begin = end
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(out[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select(id_column, text_column), run, schema)
