"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton of all tokens gives the longest token at every place of a word. The encoder takes
the longest token that is compatible with the one before it, and goes back when no token fits. Two tokens
are compatible if merging their joined text would keep the border between them; a table keeps the answers. The
tokens found this way are exactly those of the merges, and no place is visited twice, so time is linear.

The tokenizer file is read on the driver and sent to the tasks; its size is that of its vocabulary. Words are kept with their
tokens in two generations: a full young one becomes the old one, and words met again move on to the young one.

A null text is encoded as an empty one. Texts of any length are encoded whole. Repeated rows and null ids are kept. An
empty table gives an empty result. Input columns are kept, but for those with the name of a column made here.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from methmix.llm.common import table, without
from methmix.llm.registry import query
from methmix.llm.words import slices

# Words of a generation: one worker keeps the tokens of the words met last, of two generations at most.
CACHED_WORDS = 150_000
# White-space chunks of several words that one worker keeps.
CACHED_CHUNKS = 30_000
# Longer words and chunks are not kept.
LONGEST_CACHED = 64
# Pairs of tokens whose compatibility one worker remembers.
CACHED_PAIRS = 250_000
NO_LIMIT = 1 << 40
# A pair of ranks as one number.
PAIR_SHIFT = 32
# Control characters that str.split() takes for white space and the tokenizer does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters stand for
    themselves, the other bytes in order for the letters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in visible}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(visible)))
    return [letters[b] for b in range(256)]


class Encoder:
    """Encoder and decoder of one tokenizer file: word-end BPE over byte letters."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                                          if p["type"] == "Split"))
        letters = byte_letters()
        # In a word, a letter's code is its byte, and 256 more if it ends the word. A token is a string of codes.
        code = {letter: chr(b) for b, letter in enumerate(letters)}
        ended = {letter: chr(256 + b) for b, letter in enumerate(letters)}

        def coded(token: str) -> str:
            if token.endswith(self.suffix):
                token = token.removesuffix(self.suffix)
                return "".join(code[c] for c in token[:-1]) + ended[token[-1]]
            return "".join(code[c] for c in token)

        # Tokens by rank: the single letters, then the merges in order.
        self.ids = [0] * (512 + len(model["merges"]))
        names = [*(chr(c) for c in range(512))]
        for b, letter in enumerate(letters):
            self.ids[b], self.ids[256 + b] = vocabulary[letter], vocabulary[letter + self.suffix]
        rank_of = {name: rank for rank, name in enumerate(names)}
        self.left, self.right = list(range(512)), list(range(512))
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"], 512):
            first, second = pair.split(" ") if isinstance(pair, str) else pair
            a, b = rank_of[coded(first)], rank_of[coded(second)]
            names.append(names[a] + names[b])
            rank_of.setdefault(names[rank], rank)
            self.ids[rank] = vocabulary[first + second]
            self.left.append(a)
            self.right.append(b)
            self.merged[a << PAIR_SHIFT | b] = rank
        self.lengths = [len(n) for n in names]
        self.automaton = ahocorasick.Automaton()
        for name, rank in rank_of.items():
            self.automaton.add_word(name, rank)
        self.automaton.make_automaton()
        # The longest token that begins a token, or -1.
        self.shorter = [next((rank_of[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in rank_of), -1) for n in names]
        self.compatible: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

        # Decoding: the bytes of every id in one array, with the offset of each; tokens are set off by one space.
        by_id = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        size = max(by_id) + 1
        texts = [(by_id.get(i, "") + " ").encode() for i in range(size)]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)

    def fits(self, first: int, second: int) -> bool:
        """Whether merging the texts of two tokens side by side keeps the border between them.

        The merges of both are undone from the latest on. If at any time the two parts at the border merge
        earlier than what was undone last, the merge would have crossed the border.
        """
        known = self.compatible.get(first << PAIR_SHIFT | second)
        if known is not None:
            return known
        a, b, limit = first, second, NO_LIMIT
        while True:
            if self.merged.get(a << PAIR_SHIFT | b, limit) < limit:
                answer = False
                break
            undo_left = a > b
            for _ in range(2):
                part = a if undo_left else b
                limit = a if undo_left else b + 1
                if undo_left:
                    a = self.right[a]
                    moved = a != part
                else:
                    b = self.left[b]
                    moved = b != part
                if moved:
                    break
                undo_left = not undo_left
            if not moved:
                answer = True
                break
        if len(self.compatible) >= CACHED_PAIRS:
            self.compatible.clear()
        self.compatible[first << PAIR_SHIFT | second] = answer
        return answer

    def _word(self, data: bytes) -> list[int]:
        """Ranks of the tokens of one word."""
        word = data[:-1].decode("latin-1") + chr(256 + data[-1])
        n = len(word)
        longest = [-1] * n
        lengths, shorter = self.lengths, self.shorter
        for end, rank in self.automaton.iter(word):
            start = end - lengths[rank] + 1
            # Matches come in order of their ends, so the last one from a place is the longest.
            longest[start] = rank
        open_ = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + lengths[token]
            if open_[end] and (not tokens or self.fits(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = tokens.pop()
                at -= lengths[token]
        return tokens

    def _packed(self, word: str) -> bytes:
        """Packed ids of a word."""
        packed = self.young.get(word)
        if packed is not None:
            return packed
        packed = self.old.get(word)
        if packed is None:
            packed = array("i", map(self.ids.__getitem__, self._word(word.encode()))).tobytes()
            if len(word) > LONGEST_CACHED:
                return packed
        if len(self.young) >= CACHED_WORDS:
            self.young, self.old = {}, self.young
        self.young[word] = packed
        return packed

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a text without white space."""
        packed = self.chunks.get(chunk)
        if packed is not None:
            return packed
        words = self.pattern.findall(chunk)
        if len(words) == 1:
            return self._packed(words[0])
        packed = b"".join(map(self._packed, words))
        if len(chunk) <= LONGEST_CACHED:
            if len(self.chunks) >= CACHED_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Letter by letter, so a capital sigma has one small form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if SEPARATORS.search(text):
            return b"".join(self._chunk(c) for c in regex.split(r"[^\S\x1c-\x1f]+", text) if c)
        encode, out = self._chunk, []
        for chunk in text.split():
            # A chunk of one word is most often known.
            packed = self.young.get(chunk)
            out.append(encode(chunk) if packed is None else packed)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """int32 ids. Special tokens in the text keep their ids."""
        out, at = [], 0
        if self.special and "<|" in text:
            for match in self.special_pattern.finditer(text):
                out += [self._plain(text[at:match.start()]), np.int32(self.special[match.group()]).tobytes()]
                at = match.end()
        out.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, UTF-8."""
        out = []
        for at in range(0, len(ids), 1 << 16):
            some = ids[at:at + (1 << 16)]
            starts = self.offsets[some]
            sizes = self.offsets[some + 1] - starts
            ends = np.cumsum(sizes)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes())
        return b"".join(out)[:-1]


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content, built once."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _definition(docs: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _with_columns(docs: DataFrame, added: str, column: str, make, shared) -> DataFrame:
    """`docs` with columns from make(encoder, values of `column`), a list for each value."""
    kinds = T.StructType.fromDDL(added)
    docs = without(docs, kinds.names)
    arrow = to_arrow_schema(kinds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            rows = make(coder, batch)
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.nulls(0, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *kinds.names])
    sliced = (lambda batches: task(slices(batches, column))) if docs.schema[column].dataType == T.StringType() else task
    return docs.mapInArrow(sliced, T.StructType(docs.schema.fields + kinds.fields))


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens and token_ids (array<int>)."""
    def make(coder: Encoder, batch: pa.RecordBatch) -> list[tuple]:
        return [(len(ids), ids) for ids in (coder.encode(text or "") for text in batch.column(text_col).to_pylist())]
    return _with_columns(docs, "n_tokens bigint, token_ids array<int>", text_col, make, _definition(docs, tokenizer_path))


def decode_tokens(encoded: DataFrame, tokenizer_path: str, ids_col: str = "token_ids") -> DataFrame:
    """`encoded` with decoded, the text of its ids; null ids give an empty text."""
    def make(coder: Encoder, batch: pa.RecordBatch) -> list[tuple]:
        return [(coder.decode(np.asarray(ids.as_py() or [], np.int32)).decode(),) for ids in batch.column(ids_col)]
    return _with_columns(encoded, "decoded string", ids_col, make, _definition(encoded, tokenizer_path))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens, token_ids and decoded, in one pass over the texts."""
    def make(coder: Encoder, batch: pa.RecordBatch) -> list[tuple]:
        encoded = (coder.encode(text or "") for text in batch.column(text_col).to_pylist())
        return [(len(ids), ids, coder.decode(ids).decode()) for ids in encoded]
    return _with_columns(docs, "n_tokens bigint, token_ids array<int>, decoded string", text_col, make, _definition(docs, tokenizer_path))


def _digests(text_col: str):
    def make(coder: Encoder, batch: pa.RecordBatch) -> list[tuple]:
        decimals = coder.__dict__.setdefault("decimals", [str(i) for i in range(len(coder.offsets))])
        rows = []
        for text in batch.column(text_col).to_pylist():
            ids = coder.encode(text or "")
            line = " ".join(map(decimals.__getitem__, ids.tolist()))
            rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
        return rows
    return make


@query("op8_bpe_encode_decode")
def op8_bpe_encode_decode(spark, sf_dir):
    """Token counts and digests of ids and decoded texts."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_columns(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", "text", _digests("text"),
                         _definition(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("text")
