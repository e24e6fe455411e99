"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch are laid out in one array of symbols. An index maps each mergeable pair
to all its positions; active ranks are applied in ascending order, and each merge updates the lists
of the pairs beside it. That equals merging word by word, as no merge of a vocabulary makes a pair of
a lower rank; this is checked when the file is loaded.

Defined results: a null or empty text has no ids and decodes to the empty text; other columns of the
input are not looked at; repeated rows give repeated rows; no rows give no rows."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sparkloom.llm.common import once_a_worker, slices

WORD_BPE = "word_bpe_49k.json"
#: Chunks whose ids a Python worker keeps; beyond it starts anew.
CACHED_CHUNKS = 800_000
#: Where a symbol was that a merge has taken.
DEAD = 1 << 30
NOT_LATIN = re.compile("[^\\x00-\\u017f]")
LATIN = {k: [c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k] for k in "LN"}
#: White space by the Unicode property; ``str.split`` also cuts at four separators that are none.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SEPARATOR = re.compile("[\\x1c-\\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByChunk:
    """Ids of texts from those of their chunks between white space, which no token spans.

    Ids of chunks stay in the worker's memory, up to CACHED_CHUNKS."""

    width = 4

    def __init__(self):
        self.ids: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        raise NotImplementedError

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width`` bytes."""
        if len(self.ids) > CACHED_CHUNKS:
            self.ids = {}
        cut = [(SPACE.split(t) if SEPARATOR.search(t) else t.split()) if t else [] for t in texts]
        known = self.ids
        found = [list(map(known.get, chunks)) for chunks in cut]
        lacking = [k for k, ids in enumerate(found) if None in ids]
        if lacking:
            self.add({c for k in lacking for c, x in zip(cut[k], found[k], strict=True) if x is None})
            for k in lacking:
                found[k] = [known[c] if x is None else x for c, x in zip(cut[k], found[k], strict=True)]
        return [b"".join(ids) for ids in found]

    def add(self, new: set[str]) -> None:
        """Latin letters with ASCII punctuation behind them are learned apart, as many chunks share them: no token
        spans the two. Of one letter (U+0130) the lower case ends in a mark, which goes with the punctuation."""
        apart: list[tuple[str, str, str]] = []
        needed: set[str] = set()
        for c in new:
            core = c.rstrip(ASCII_MARKS)
            if core.isalpha() and (core.isascii() or not NOT_LATIN.search(core) and "\u0130" not in core):
                low = core.lower()
                needed.add(low)
                if low is not c:
                    tail = c[len(core) :]
                    apart.append((c, low, tail))
                    if tail:
                        needed.add(tail)
            else:
                needed.add(c)
        if needed := [c for c in needed if c not in self.ids]:
            self.learn(needed)
        ids = self.ids
        for c, low, tail in apart:
            ids[c] = ids[low] + ids[tail] if tail else ids[low]


class LibraryEncoder(ByChunk):
    """The tokenizers library, asked once for each distinct chunk.

    Latin letters alone are one word each, and of a word only the last token ends it, so many go as one text."""

    def __init__(self, path: str, width: int = 4):
        super().__init__()
        self.width = width
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for s, i in model["vocab"].items() if s.endswith(end)]] = True

    def learn(self, chunks: list[str]) -> None:
        words = [c for c in chunks if c.isalpha() and (c.isascii() or not NOT_LATIN.search(c) and "\u0130" not in c)]
        texts = [words[at : at + 500] for at in range(0, len(words), 500)]
        for some, e in zip(texts, self.tokenizer.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            upto = np.concatenate([[0], self.width * (np.flatnonzero(self.ends[ids]) + 1)]).tolist()
            raw = ids.astype(f"<u{self.width}").tobytes()
            self.ids.update(zip(some, [raw[a:z] for a, z in zip(upto, upto[1:], strict=False)], strict=True))
        rest = [c for c in chunks if c not in self.ids]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.ids[c] = array("I" if self.width == 4 else "H", e.ids).tobytes()


class WordBpe(ByChunk):
    """A tokenizer file of kind BPE with word ends, as the tokenizers library applies it."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge needs a symbol that only a later merge makes")
            c = vocab[model["merges"][rank].replace(" ", "", 1) if isinstance(pair, str) else "".join(pair)]
            self.merges[a << 16 | b] = rank, c
            made[c] = rank
        self.keys = np.array(sorted(self.merges))
        self.ranks = np.array([self.merges[k][0] for k in self.keys.tolist()])
        symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + end] for s in symbols])
        self.special = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name in "LN":  # within Latin, the classes are spelled out, as ``re`` has no \\p
            pattern = pattern.replace(f"\\p{{{name}}}", "".join(map(re.escape, LATIN[name])))
        self.latin_words = re.compile(pattern.replace(r"\s", "\\t-\\r \\x85\\xa0")).findall
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def words(self, part: str) -> list[bytes]:
        """UTF-8 of the pieces that are merged each on its own."""
        if not NOT_LATIN.search(part):
            text = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).lower()
            return [w.encode() for w in self.latin_words(text)]
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def learn(self, chunks: list[str]) -> None:
        cut: list[list[bytes]] = []
        for c in chunks:
            if "<|" in c:
                pieces: list[bytes] = []
                for k, part in enumerate(self.split_special.split(c)):
                    pieces += [part.encode()] if k % 2 else self.words(part)
                cut.append(pieces)
            else:
                cut.append(self.words(c))
        special = {k.encode(): v for k, v in self.special.items()}
        merged = special | self.merged(list({w for words in cut for w in words} - special.keys()))
        ids = merged.__getitem__
        for c, words in zip(chunks, cut, strict=True):
            self.ids[c] = b"".join(map(ids, words))

    def merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word; all are merged together, rank by rank."""
        if not words:
            return {}
        length = np.array([len(w) for w in words])
        ends = np.cumsum(length)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        nxt_, prv_ = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        nxt_[ends - 1] = -1
        prv_[ends - length] = -1
        # the index: positions of each pair that a merge has, in order
        pairs = symbols[:-1] << 16 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        there = np.flatnonzero((self.keys[at] == pairs) & (nxt_[:-1] >= 0))
        rank_at = self.ranks[at[there]]
        order = np.argsort(rank_at, kind="stable")
        active, first = np.unique(rank_at[order], return_index=True)
        where = {r: p.tolist() for r, p in zip(active.tolist(), np.split(there[order], first[1:]), strict=True)} if len(there) else {}
        heap = active.tolist()  # ascending, so a heap

        sym, nxt, prv, merges = symbols.tolist(), nxt_.tolist(), prv_.tolist(), self.merges
        while heap:
            rank = heapq.heappop(heap)
            for p in sorted(where.pop(rank)):
                q = nxt[p]
                if q < 0 or (hit := merges.get(sym[p] << 16 | sym[q])) is None or hit[0] != rank:
                    continue  # a merge beside it has taken one of the two
                made = sym[p] = hit[1]
                sym[q] = DEAD
                after, before = nxt[q], prv[p]
                nxt[p], nxt[q] = after, -1
                if after >= 0:
                    prv[after] = p
                    if new := merges.get(made << 16 | sym[after]):
                        if new[0] in where:
                            where[new[0]].append(p)
                        else:
                            where[new[0]] = [p]
                            heapq.heappush(heap, new[0])
                if before >= 0 and (new := merges.get(sym[before] << 16 | made)):
                    if new[0] in where:
                        where[new[0]].append(before)
                    else:
                        where[new[0]] = [before]
                        heapq.heappush(heap, new[0])
        flat = np.array(sym)
        stays = flat != DEAD
        upto = np.concatenate([[0], np.cumsum(stays)[ends - 1]]).tolist()
        ids = flat[stays].astype("<u4").tobytes()
        return {w: ids[4 * a : 4 * z] for w, a, z in zip(words, upto, upto[1:], strict=False)}

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so tokens are joined by spaces; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str) -> WordBpe:
    return once_a_worker(("word bpe", path), lambda: WordBpe(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of each row of ``docs(doc_id, text)``."""
    path = path or public_tokenizers.path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = loaded(path).encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row of ``encoded(doc_id, ids)``; null ids give the empty text."""
    path = path or public_tokenizers.path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [loaded(path).decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass over the texts."""
    path = path or public_tokenizers.path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in slices(batches):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
