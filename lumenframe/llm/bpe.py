"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever builds what is inside a vocabulary token, so two neighbouring symbols that are neighbours in no token
are never joined: between them lies a certain cut. Words are split at these cuts, the fragments are encoded on their
own (and kept in a bounded cache), and the ids are concatenated.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the strings of special tokens become
their ids; extra columns are ignored; repeated rows give repeated results. Texts are never cut short; a very long word
is merged with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import table

END = "</w>"
#: What the pattern's \\s stands for: Unicode white space (fixed values), without the separators U+001C to U+001F that Python adds.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries that a worker keeps of each of its two caches.
CACHE_ENTRIES = 300_000
#: The words it holds have at most so many characters in sum, unless one text alone has more.
CACHE_CHARS = 1 << 24


@cache
def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible in Latin-1, else 256 and up in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(p)) for p in range(0x250) if unicodedata.category(chr(p))[0] == kind)


class ForcedBoundaryBPE:
    """Reads a tokenizer file of kind: NFC, white space, lower case; a split pattern; byte level; BPE with word ends."""

    def __init__(self, content: bytes, cache_entries: int = CACHE_ENTRIES) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.ranks = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])}
        self.joined = {pair for t in self.vocab for u in [self.units(t)] for pair in zip(u, u[1:], strict=False)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", SPACE)
        self.words_of = regex.compile(pattern).findall
        letters, numbers = _latin("L"), _latin("N")
        latin = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
        self.latin_words_of = re.compile(latin).findall
        self.beyond_latin = re.compile("[^\x00-ɏ]").search
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.cache_entries, self.cached_chars = cache_entries, 0
        self.fragments: dict[tuple[str, ...], list[int]] = {}
        self.words: dict[str, str] = {}
        self.spelled: dict[str, str] = {}

    @staticmethod
    def units(token: str) -> list[str]:
        """The smallest symbols of a token: one for each byte, the last with the word end if it has one."""
        if token.endswith(END) and len(token) > len(END):
            stem = token[: -len(END)]
            return [*stem[:-1], stem[-1] + END]
        return list(token)

    def merge(self, units: list[str]) -> list[int]:
        """Byte-pair merges of one fragment: always the pair of least rank, the leftmost first."""
        n, ranks = len(units), self.ranks
        if n == 1:
            return [self.vocab[units[0]]]
        left, right, part = list(range(-1, n - 1)), [*range(1, n), -1], [*units]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] == a else -1
            if j < 0 or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := left[i]) >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [self.vocab[p] for p in part if p]

    def cut(self, units: list[str]) -> Iterator[tuple[str, ...]]:
        at = 0
        for i in range(1, len(units)):
            if (units[i - 1], units[i]) not in self.joined:
                yield tuple(units[at:i])
                at = i
        yield tuple(units[at:])

    def encode_word(self, word: str) -> list[int]:
        symbols = _byte_symbols()
        units = [symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        units[-1] += END
        ids: list[int] = []
        for fragment in self.cut(units):
            found = self.fragments.get(fragment)
            if found is None:
                found = self.merge(list(fragment))
                if len(fragment) <= 64:
                    if len(self.fragments) >= self.cache_entries:
                        self.fragments.clear()
                    self.fragments[fragment] = found
            ids += found
        return ids

    def split(self, text: str) -> list[str]:
        """Normalised words of a stretch without special tokens. White space only separates, so runs need no folding."""
        if self.beyond_latin(text):
            # every character is lowered on its own: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return self.words_of(text)
        # below U+0250 composition changes nothing; İ alone lowers to more than one character, beyond the short classes
        return self.words_of(text.lower()) if "İ" in text else self.latin_words_of(text.lower())

    def learn(self, words: list[str]) -> None:
        """Puts into the caches what they lack of these words."""
        new = {w for w in words if w not in self.words}
        more = sum(map(len, new))
        if len(self.words) + len(new) > self.cache_entries or self.cached_chars + more > CACHE_CHARS:
            self.words.clear()
            self.spelled.clear()
            new = {*words}
            self.cached_chars, more = 0, sum(map(len, new))
        self.cached_chars += more
        for w in new:
            ids = self.encode_word(w)
            self.words[w] = " ".join(map(str, ids))
            self.spelled[w] = " ".join(self.tokens[i] for i in ids)

    def run(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by one space, decoded text) of a whole text."""
        ids: list[str] = []
        decoded: list[str] = []
        for piece in self.special_split(text) if any(x in text for x in self.special) else (text,):
            if piece in self.special:
                ids.append(str(self.special[piece]))
                decoded.append(piece)
                continue
            words = self.split(piece)
            try:
                ids += map(self.words.__getitem__, words)
            except KeyError:
                self.learn(words)
                del ids[len(decoded) :]
                ids += map(self.words.__getitem__, words)
            decoded += map(self.spelled.__getitem__, words)
        return " ".join(ids), " ".join(decoded)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.run(text or "")[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones too: what decoding without a decoder step gives."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_models: dict[int, ForcedBoundaryBPE] = {}


def model(content: bytes) -> ForcedBoundaryBPE:
    """One model a worker process, from the bytes of its vocabulary file."""
    if hash(content) not in _models:
        _models[hash(content)] = ForcedBoundaryBPE(content)
    return _models[hash(content)]


def encode_documents(docs: DataFrame, path: str, give: str = "ids array<int>, decoded string") -> DataFrame:
    """doc_id, n_tokens and what is asked for of ids (array<int>), decoded, ids_sha256 and decoded_sha256 (hex; string)."""
    asked = [x.split()[0] for x in give.split(", ")]
    # the driver reads the vocabulary, a few MB, and sends it: executors need no copy of the file
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    makers = {
        "ids": lambda ids, _: np.array(ids.split(), np.int32),
        "decoded": lambda _, decoded: decoded,
        "ids_sha256": lambda ids, _: hashlib.sha256(ids.encode()).hexdigest(),
        "decoded_sha256": lambda _, decoded: hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(sent.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n, columns = [], [[] for _ in asked]
                for value in batch.column(1):
                    ids, decoded = bpe.run(value.as_py() or "")
                    n.append(ids.count(" ") + 1 if ids else 0)
                    for name, column in zip(asked, columns, strict=True):
                        column.append(makers[name](ids, decoded))
                arrays = [pa.array(c, pa.list_(pa.int32()) if name == "ids" else pa.string()) for name, c in zip(asked, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *arrays], ["doc_id", "n_tokens", *asked])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {give}")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), "ids_sha256 string, decoded_sha256 string")
